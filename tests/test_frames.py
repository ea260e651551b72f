"""Rows that a task makes leave it in few frames."""

import pandas as pd

from lineproof.operators import audits as A
from lineproof.operators import responses as R


def frames_of(monkeypatch, module):
    made = []
    whole = pd.DataFrame

    class Counted:
        DataFrame = staticmethod(lambda *a, **k: made.append(1) or whole(*a, **k))

    monkeypatch.setattr(module, "pd", Counted)
    return made


class Mapped:
    """Stands for a table of which only mapInPandas is asked."""

    def __init__(self, frame):
        self.frame, self.schema = frame, {"k": type("Field", (), {"dataType": type("Kind", (), {"simpleString": lambda self: "bigint"})()})()}

    def select(self, *_):
        return self

    def mapInPandas(self, run, _):  # noqa: N802
        return list(run(iter([self.frame])))


def test_readings_leave_in_few_frames(monkeypatch):
    made = frames_of(monkeypatch, R)
    images = pd.DataFrame({"k": range(500), "content": [b"x", b""] * 250})
    found = R.recognised(Mapped(images), "k", lambda image: [{"text": "t", "score": 1, "box": [0, 0, 1, 1]}] * 3 if image else [])
    assert sum(map(len, found)) == 750 and len(made) == 1


def test_chunks_leave_in_few_frames(spark, monkeypatch):
    made = frames_of(monkeypatch, A)
    found = A.byte_chunks(Mapped(pd.DataFrame({"doc_id": range(300), "text": ["a b c", None, ""] * 100})), 4)
    assert [len(f) for f in found] == [200] and len(made) == 1
