"""The rolling fold asks its state no more than it must."""

from pyspark.sql import Row

from quire.streaming import jobs as J


class _State:
    """A value or map state that counts the messages it gets."""

    def __init__(self, sent):
        self.sent, self.value = sent, None

    def __getattr__(self, name):
        def message(*args):
            self.sent.append(name)
            held = self.value if isinstance(self.value, dict) else {}
            if name in ("update", "clear"):
                self.value = args[0] if args else None
            elif name == "updateValue":
                self.value = held | {args[0]: args[1]}
            elif name == "removeKey":
                self.value = {k: v for k, v in held.items() if k != args[0]}
            return {"exists": bool(self.value), "get": self.value, "containsKey": bool(args) and args[0] in held, "getValue": held.get(args[0]) if args else None}.get(name)

        return message


class _Handle:
    def __init__(self):
        self.sent = []

    def getValueState(self, name, schema):
        return _State(self.sent)

    def getMapState(self, name, key, value):
        return _State(self.sent)


def test_a_whole_document_costs_two_messages():
    handle, fold = _Handle(), J.RollingRows(lambda prev, c: c if prev is None else prev + "|" + c)
    fold.init(handle)
    feed = lambda *rows: [tuple(r) for r in fold.handleInputRows((7,), iter([Row(doc_id=7, chunk_no=n, n_chunks=3, chunk=c) for n, c in rows]), None)]
    assert feed((1, "b"), (0, "a"), (2, "c")) == [(7, 0, "a"), (7, 1, "a|b"), (7, 2, "a|b|c")]
    assert handle.sent == ["get", "update"]
    assert feed((1, "b")) == [] and fold.next.value == (3, 3)


def test_parts_of_a_document_in_any_order():
    handle, fold = _Handle(), J.RollingRows(lambda prev, c: c if prev is None else prev + "|" + c)
    fold.init(handle)
    feed = lambda n, c: [tuple(r)[1:] for r in fold.handleInputRows((7,), iter([Row(doc_id=7, chunk_no=n, n_chunks=4, chunk=c)]), None)]
    assert feed(0, "a") == [(0, "a")] and fold.last.value == ("a",)
    assert feed(2, "c") == [] and feed(3, "d") == []
    assert feed(1, "b") == [(1, "a|b"), (2, "a|b|c"), (3, "a|b|c|d")]
    assert not fold.waiting.value and not fold.last.value and fold.next.value == (4, 4)
