"""Of an Arrow batch only a few values at a time are Python objects."""

import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.functions import text as x


def test_few_at_once():
    kept = {}

    def udf(run, kind):
        kept["run"] = run
        return lambda c: c

    given, F.arrow_udf = F.arrow_udf, udf
    try:
        x.each(None, lambda t: None if t is None else [t], "array<string>", pa.list_(pa.string()))
    finally:
        F.arrow_udf = given
    sizes = []

    class Seen:
        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, at, n):
            part = self.values.slice(at, n)
            sizes.append(len(part))
            return part

    texts = pa.array([None if k % 7 == 0 else str(k) for k in range(1000)])
    out = kept["run"](Seen(texts))
    assert out.to_pylist() == [None if t is None else [t] for t in texts.to_pylist()]
    assert max(sizes) <= x.AT_ONCE and sum(sizes) == 1000
    assert kept["run"](pa.array([], pa.string())).to_pylist() == []
