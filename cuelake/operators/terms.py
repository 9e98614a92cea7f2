"""Terms of a glossary in texts: one pass over the texts for all terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

#: Terms that are sent to all tasks at once (some 200 bytes each there); a larger glossary takes a pass for each so many.
BLOCK = 200_000


class _Terms:
    """Terms as they are sent, and their automaton, which each Python worker makes once."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.automaton: ahocorasick.Automaton | None = None

    def __getstate__(self) -> list[str]:
        return self.terms

    def __setstate__(self, terms: list[str]) -> None:
        self.__init__(terms)

    def counts(self, text: str) -> Counter:
        """How often each term is in the text; a term's occurrences do not overlap, the first ones count."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for t in self.terms:
                self.automaton.add_word(t, t)
            self.automaton.make_automaton()
        out, ends = Counter(), {}
        for at, t in self.automaton.iter(text):
            if at - len(t) >= ends.get(t, -1):
                ends[t] = at
                out[t] += 1
        return out


def count_terms(rows: DataFrame, keys: list[str], text: str, terms: DataFrame, block: int = BLOCK) -> DataFrame:
    """keys, low, n: for each row the terms (low) that its text holds, as they are written, and how often; without keys for
    some rows together. Empty and null terms and texts have none."""
    terms = terms.select("low").where("low <> ''").distinct()
    blocks = max(1, -(-terms.count() // block))  # the check of the size: so many are sent at most
    schema = StructType([*rows.select(*keys).schema.fields]).add("low", StringType()).add("n", LongType())
    kinds = to_arrow_schema(schema)
    out = None
    for k in range(blocks):
        part = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("low"), F.lit(blocks)) == k)
        sent = rows.sparkSession.sparkContext.broadcast(_Terms([r["low"] for r in part.collect()]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches if sent.value.terms else ():
                texts = batch.column(text).to_pylist()
                if not keys:
                    total: Counter = Counter()
                    for t in texts:
                        if t:
                            total.update(sent.value.counts(t))
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=kinds)
                    continue
                found = [(at, t, n) for at, x in enumerate(texts) if x for t, n in sent.value.counts(x).items()]
                at = pa.array([f[0] for f in found], pa.int64())
                columns = [batch.column(c).take(at).cast(kinds.field(c).type) for c in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64())], schema=kinds)

        made = rows.select(*keys, text).mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    return out
