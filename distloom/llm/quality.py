"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps its measurements and one bit for each rule
that failed; a policy is a named mask over these bits, so verdicts of any policy version and ablations
(what would a policy keep without rule r?) are bitwise operations on the ledger and never read a text again. `keep` writes
the ledger and applies a policy to it; a stored ledger serves any later policy.

Edge cases: a null text has no words and fails `few_words`; an empty text likewise. Repeated rows, and rows of one doc_id or
none, get one ledger row each; what a text is told by is the text. Measurements are whole numbers, and a rule's bound itself
passes. Very long texts are measured whole. Other input columns are ignored by the ledger and kept by `keep`. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from distloom.llm.common import cut, sieve, text_key

#: Rule i sets bit 1 << i where its condition over the measurements holds.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines",
    "long_words": "word_chars > 40 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "one_long_line": "n_lines = 1 AND n_words > 5000",
    "symbol_lines": "n_symbols > 50 * n_lines",
}

#: Policy version -> the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "long_words"),
    "v3": ("few_words", "repeated_windows", "symbols", "repeated_lines", "long_words", "short_words", "one_long_line", "symbol_lines"),
}
CURRENT = "v1"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"
WINDOW = 5


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of `width` words that occur twice or more in the text, the first occurrence included."""
    n = len(words)
    if n <= width:
        return 0
    first: dict[bytes, int] = {}
    ids = np.array(list(map(first.setdefault, words, range(n))), dtype=np.uint64)
    m = n - width + 1
    key = np.zeros(m, dtype=np.uint64)
    bound = 1
    for k in range(width):
        if bound * n >= 1 << 64:  # ranks instead of the packed number: still exact
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            bound = m
        key = key * np.uint64(n) + ids[k : k + m]
        bound *= n
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    starts = np.zeros(n + 1, dtype=np.int64)
    twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    starts[twice] += 1
    starts[twice + width] -= 1
    return int(np.count_nonzero(np.cumsum(starts)[:n]))


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at ASCII white space only
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _measured(docs: DataFrame) -> DataFrame:
    """All columns of docs and a struct __ledger with the measurements of column text."""
    at = docs.columns.index("text")
    fields = [pa.field(m, pa.int64()) for m in MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t.as_py()) for t in batch.column(at)]
            column = pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(len(fields))], fields=fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "__ledger"])

    schema = StructType([*docs.schema.fields, StructField("__ledger", StructType([StructField(m, LongType()) for m in MEASURES]))])
    return docs.mapInArrow(run, schema)


def mask(policy: str, without: str | None = None) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy] if r != without)


def ledger(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key, the measurements, and failures: one bit for each rule of RULES that fails."""
    measured = _measured(docs.select(key, "text")).select(key, "__ledger.*")
    return measured.withColumn("failures", _failures())


def _failures() -> Column:
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return failures.cast("long")


def accepted(failures: Column, policy: str = CURRENT) -> Column:
    return failures.bitwiseAND(F.lit(mask(policy))) == 0


def sole_rule(failures: Column, policy: str = CURRENT) -> Column:
    """The one rule without which the policy would keep a document that it rejects; null if there is no such rule."""
    failed, names = failures.bitwiseAND(F.lit(mask(policy))), list(RULES)
    cases = [F.when(failed == 1 << names.index(r), F.lit(r)) for r in POLICIES[policy]]
    return F.coalesce(*cases)


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger by text_key, written out."""
    return cut(ledger(docs.select(text_key(F.col("text")).alias("text_key"), "text"), "text_key"))


def keep(docs: DataFrame, policy: str = CURRENT, entries: DataFrame | None = None) -> DataFrame:
    """The rows of docs that the policy accepts by their stored ledger, made here if none is given. Accepted rows stay where they are."""
    entries = stored_ledger(docs) if entries is None else entries
    rejected = entries.where(~accepted(F.col("failures"), policy)).select("text_key").distinct()
    maybe, others = sieve(docs.withColumn("__key", text_key(F.col("text"))), rejected.withColumnRenamed("text_key", "__key"), "__key")
    passed = maybe.join(rejected, maybe["__key"] == rejected.text_key, "left_anti")
    return passed.unionByName(others).drop("__key")


def ablations(entries: DataFrame) -> DataFrame:
    """For each policy and each of its rules: documents kept, and those that only this rule rejects.

    The ledger is first counted by its bits (at most 2**rules rows), which combines before the shuffle.
    """
    counts = entries.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    cases = [(p, r, mask(p), mask(p, r)) for p in POLICIES for r in POLICIES[p]]
    one = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(full).alias("full"), F.lit(less).alias("less")) for p, r, full, less in cases])).alias("case")
    kept = lambda m: F.col("failures").bitwiseAND(F.col(f"case.{m}")) == 0
    return (
        counts.select("failures", "n", one)
        .groupBy(F.col("case.policy").alias("policy"), F.col("case.rule").alias("rule"))
        .agg(
            F.sum(F.when(kept("full"), F.col("n")).otherwise(0)).alias("n_kept"),
            F.sum(F.when(kept("less") & ~kept("full"), F.col("n")).otherwise(0)).alias("n_only_this_rule"),
        )
    )
