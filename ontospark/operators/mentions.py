"""Mentions of very many names in literals, in one pass.

Names make an Aho-Corasick automaton, which reads a text once however many names there are. Names of ``MOST`` characters together go to the tasks
at once; more are split by hash into parts of about that size, each with a pass of its own.

Defined cases: a literal counts once for a name, however often it has it; null and empty names are none; repeated names are one; names that
no literal has give no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Characters of the names of a part.
MOST = 1 << 24


def _finder(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, name in enumerate(names):
            automaton.add_word(name, i)
        automaton.make_automaton()
        for batch in batches:
            found: Counter[int] = Counter()
            for text in batch.column("o"):
                found.update({i for _, i in automaton.iter(text.as_py())})
            yield pa.record_batch([pa.array([names[i] for i in found], pa.string()), pa.array(found.values(), pa.int64())], ["name", "n"])

    return find


def mentions(g: DataFrame, names: DataFrame, most: int = MOST) -> DataFrame:
    """``name, n``: how many literals have each of ``names.name``."""
    own = written(names.select("name").where("name <> ''").distinct(), "names")
    total = own.agg(F.sum(F.length("name")).alias("n")).first().n or 0
    parts, texts, out = max(1, -(-total // most)), g.where("o_kind = 'literal'").select("o"), None
    for part in range(parts):
        some = [r.name for r in own.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part).collect()]  # about ``most`` characters
        if some:
            one = texts.mapInArrow(_finder(some), "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
            out = one if out is None else out.unionByName(one)
    return own.select("name", F.lit(0).cast("bigint").alias("n")).where("false") if out is None else out
