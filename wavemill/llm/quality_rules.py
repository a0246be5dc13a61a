"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps each document's
measurements and one ``fail_bits`` long in which bit b is set when rule b
fails.  A policy is a versioned set of rules, so applying one, comparing two or
leaving a rule out is bitwise arithmetic on the ledger; texts are not read
again.

The rules see whole texts.  Everything is per row, so no shuffle is needed and
a lost task is simply run again.  The 8-word windows of a document are compared
by 64-bit hashes within that document.

Null texts count as empty (no words).  Repeated rows are judged one by one.
Extra columns of the input are not carried unless named in ``keep``; a kept
column with the name of a measure is an error.  No documents give no rows.  A
very long text is handled whole, by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

REPEAT_WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaim", "n_long_words")

#: Rules in bit order: name, and when it fails, over the measures.  All in
#: whole numbers, so that every engine decides alike.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("upper_case", "2 * n_upper > n_letters"),
    ("exclamations", "5 * n_exclaim > n_words"),
    ("long_words", "20 * n_long_words > n_words"),
)

BITS = {name: bit for bit, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A versioned set of rules; a document fails when any of them does."""

    version: str
    rules: Sequence[str]

    @property
    def mask(self) -> int:
        return sum(1 << BITS[r] for r in set(self.rules))


BASE = Policy("base", ("too_few_words", "repeated_windows"))
PRODUCTION = Policy("2", ("too_few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "upper_case", "exclamations", "long_words"))

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _measure(texts: pa.Array) -> dict[str, np.ndarray]:
    buf, offs = C.text_bytes(texts)
    words = C.Words(buf, offs)
    docs, counts = len(offs) - 1, words.counts

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offs[1:]] - total[offs[:-1]]

    lead = (buf & 0xC0) != 0x80
    upper, lower = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122)
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=points[1:])
    lengths = points[words.end] - points[words.start]
    out = {
        "n_words": counts.astype(np.int64),
        "word_chars": per_doc(lead & ~C._BLANK[buf]),
        "n_symbols": per_doc(_SYMBOL[buf]),
        "n_upper": per_doc(upper),
        "n_letters": per_doc(upper | lower),
        "n_exclaim": per_doc(buf == 33),
        "n_long_words": np.bincount(words.doc()[lengths > 40], minlength=docs).astype(np.int64),
    }
    out["n_lines"], out["n_dup_lines"] = _lines(buf, offs, words)

    at = C.gram_starts(words.first, REPEAT_WINDOW)
    keys = C.grams(words.hashes(), REPEAT_WINDOW)[at]
    doc = words.doc()
    keys = C.mix64(keys ^ C.mix64(doc[at].astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=docs).astype(np.int64)
    return out


def _lines(buf: np.ndarray, offs: np.ndarray, words: C.Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier one, per document."""
    docs, raw = len(offs) - 1, buf.tobytes()
    n_lines, n_dup = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    for i in range(docs):
        seen = [x for x in raw[offs[i] : offs[i + 1]].split(b"\n") if x.strip(C.BLANKS)]
        n_lines[i], n_dup[i] = len(seen), len(seen) - len(set(seen))
    return n_lines, n_dup


def measurements(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and each document's measures."""
    if clash := {k.lower() for k in keep} & {*MEASURES, "fail_bits"}:
        raise ValueError(f"kept columns have names of measures: {sorted(clash)}")
    kept = docs.select(*[F.col(k) for k in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches, len(keep)):
            found = _measure(part.column(len(keep)))
            yield C.record({k: part.column(i) for i, k in enumerate(keep)} | {m: found[m] for m in MEASURES})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{m} long" for m in MEASURES])
    return docs.select(*[F.col(k) for k in keep], C.text_of(text).alias("_text")).mapInArrow(run, schema)


def ledger(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``measurements`` and ``fail_bits``: the rules each document fails."""
    bits = F.lit(0).cast("long")
    for bit, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs, text, keep).withColumn("fail_bits", bits)


def fails(policy: Policy) -> Column:
    """Whether a ledger row fails the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    return rows.withColumn("policy", F.lit(policy.version)).withColumn("kept", ~fails(policy))


def ablations(rows: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone (and
    so would be kept without it), and documents and words the policy keeps.

    One partial aggregation by mask (at most 2**rules groups); the rest runs
    over those groups.
    """
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("mask")).agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"))
    each = masks.withColumn("rule", F.explode(F.array(*[F.struct(F.lit(r).alias("name"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in policy.rules])))
    hit = F.col("mask").bitwiseAND(F.col("rule.bit")) != 0
    alone = F.col("mask") == F.col("rule.bit")
    return each.groupBy(F.col("rule.name").alias("rule")).agg(
        F.sum(F.when(hit, F.col("docs")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(alone, F.col("docs")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(F.col("mask") == 0, F.col("docs")).otherwise(0)).alias("n_kept"),
        F.sum(F.when((F.col("mask") == 0) | alone, F.col("docs")).otherwise(0)).alias("n_kept_without"),
        F.sum(F.when((F.col("mask") == 0) | alone, F.col("words")).otherwise(0)).alias("words_kept_without"),
    )


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(C.table(spark, sf_dir, "documents")), PRODUCTION)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails(BASE).alias("base_failed"), F.expr("kept").alias("kept"), "n_lines", "n_upper", "n_letters", "n_exclaim", "n_long_words", "fail_bits")
