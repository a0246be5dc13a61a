"""Fill-in-the-middle over an index of distinct texts.

1. Texts are grouped by a 64-bit hash and their size, as counts only.  Those
   that occur once are their own index entry.
2. Of groups of several rows, one text each is kept in the index (its copies
   are combined before they are shuffled), and the ends of its tokens are
   computed once, as an Elias-Fano list: the low bits of each end as they are,
   the high ones in unary, two to four bits a token in all.
3. Copies are joined with the index by hash, size and the text itself, so only
   identical texts share a list; a text whose hash is that of another gets its
   own.  Groups of more than ``SALT_ROWS`` rows are dealt over salts, each with
   the entry, so that no task holds a large group.
4. Each row selects the two ends that its seed names.

Only texts that occur more than once are moved.  The groups' hashes are
broadcast up to ``BROADCAST_ROWS``; beyond that they are joined by shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Groups of identical texts that are broadcast; rows of a group to a salt.
BROADCAST_ROWS, SALT_ROWS = 500_000, 1000
MARKS = ("<P>", "<S>", "<M>")


def token_ends(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the tokens ``[A-Za-z]+|[^A-Za-z]`` of each text, in code
    points, joined, and where each text's begin (and the end)."""
    buf, offsets = C.text_bytes(texts)
    folded = buf | np.uint8(32)
    letter = (folded >= 97) & (folded <= 122)
    starts = (buf & np.uint8(0xC0)) != 0x80
    goes_on = np.zeros(len(buf), bool)  # a letter that a letter of the text follows
    goes_on[:-1] = letter[:-1] & letter[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(buf))]
    goes_on[inner - 1] = False
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(starts, out=points[1:])
    at = np.flatnonzero(starts & ~goes_on)
    cuts = np.searchsorted(at, offsets)
    return points[at + 1] - np.repeat(points[offsets[:-1]], np.diff(cuts)), cuts


def pack(ends: np.ndarray) -> bytes:
    """An Elias-Fano list of growing numbers: their count and low width (eight
    bytes each), the low bits, the high bits."""
    n = len(ends)
    width = max(int(ends[-1]) // n, 1).bit_length() - 1 if n else 0
    head = np.array([n, width], "<i8").tobytes()
    if not n:
        return head
    low = (ends[:, None] >> np.arange(width)) & 1
    high = np.zeros(int(ends[-1] >> width) + n, np.uint8)
    high[(ends >> width) + np.arange(n)] = 1
    return head + np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def select(packed: bytes, k: int) -> int:
    """The k-th number of the list, from 1; 0 for k = 0."""
    if k == 0:
        return 0
    n, width = np.frombuffer(packed, "<i8", 2).tolist()
    lows = -(-n * width // 8)
    high = np.frombuffer(packed, np.uint8, offset=16 + lows)
    upto = np.cumsum(np.bitwise_count(high), dtype=np.int64)
    byte = int(np.searchsorted(upto, k))
    left = k - (int(upto[byte - 1]) if byte else 0)
    bit = int(np.flatnonzero(np.unpackbits(high[byte : byte + 1], bitorder="little"))[left - 1])
    first = (k - 1) * width
    some = int.from_bytes(packed[16 + first // 8 : 16 + min((first + width + 7) // 8, lows)], "little")
    low = some >> first % 8 & (1 << width) - 1
    return (8 * byte + bit - (k - 1)) << width | low


def count(packed: bytes) -> int:
    return int(np.frombuffer(packed, "<i8", 1)[0])


@F.arrow_udf(T.BinaryType())
def boundary_list(texts: pa.Array) -> pa.Array:
    """The packed token ends of each text."""
    return pa.array(_lists(texts), pa.binary())


def _lists(texts: pa.Array) -> list[bytes]:
    out = []
    for part in C.chunks([pa.record_batch([texts], ["t"])], 0):
        ends, cuts = token_ends(part.column(0))
        out += [pack(ends[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return out


@F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in ("n", "first", "second")]))
def _cuts(texts: pa.Array, lists: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """Tokens, and the code points before the ends that the draws name.  Where
    there is no list, the text is the only one of its kind and has its own."""
    packed = lists.to_pylist()
    alone = [k for k, x in enumerate(packed) if x is None]
    for k, x in zip(alone, _lists(texts.take(pa.array(alone, pa.int64()))), strict=True):
        packed[k] = x
    counts = [count(x) for x in packed]
    units = [sorted((x % (n + 1), y % (n + 1))) for n, x, y in zip(counts, a.to_pylist(), b.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), *[pa.array([select(x, u[k]) for x, u in zip(packed, units, strict=True)], pa.int64()) for k in (0, 1)]], ["n", "first", "second"])


def _fresh(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def with_boundaries(docs: DataFrame, text: str, name: str) -> DataFrame:
    """The documents with ``name``: the boundary list of their text from the
    index of distinct texts, null where the text occurs once."""
    key, size, salt, salts, same = (_fresh(docs, f"_fim_{x}") for x in ("key", "size", "salt", "salts", "same"))
    keyed = docs.withColumns({key: F.xxhash64(text), size: F.octet_length(text)})
    groups = keyed.groupBy(key, size).count().filter("count > 1").select(key, size, F.ceil(F.col("count") / SALT_ROWS).cast("int").alias(salts))
    groups = C.durable(groups, docs.count())
    tagged = keyed.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, [key, size], "left")
    alone = tagged.filter(F.col(salts).isNull()).select(*docs.columns, F.lit(None).cast("binary").alias(name))
    copies = tagged.filter(F.col(salts).isNotNull())
    index = copies.groupBy(key, size, salts).agg(F.min(text).alias(same)).withColumn(name, boundary_list(same))
    index = index.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(salts) - 1))).drop(salts)
    dealt = copies.withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(salts)).cast("int"))
    found = dealt.join(index, [key, size, salt], "left")
    kept = F.when(F.col(text) == F.col(same), F.col(name))
    return alone.unionByName(found.select(*docs.columns, kept.alias(name)))


def fill_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 1, plain: int = 10, suffix_first: int = 20) -> DataFrame:
    """Every row with ``fim``: n, form, prefix_chars, middle_chars and output.

    A column ``fim`` of the input is replaced, others stay.  ``plain`` per cent
    of the texts and all that are empty or hold a mark stay as they are;
    ``suffix_first`` per cent of the others are spm.  Draws depend on seed and
    id, so a row without an id draws like any other such row.  A null text is
    empty; repeated rows get equal results; an empty table gives an empty one.
    """
    rows = docs.drop("fim")
    whole, lists, cut = (_fresh(rows, f"_fim_{x}") for x in ("text", "list", "cut"))
    rows = with_boundaries(rows.withColumn(whole, C.text_of(text)), whole, lists)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = rows.withColumn(cut, _cuts(F.col(whole), F.col(lists), h[0], h[1]))
    body, first, second = F.col(whole), F.col(f"{cut}.first").cast("int"), F.col(f"{cut}.second").cast("int")
    left = (body == "") | F.contains(body, F.lit(MARKS[0])) | F.contains(body, F.lit(MARKS[1])) | F.contains(body, F.lit(MARKS[2])) | (h[2] % 100 >= 100 - plain)
    form = F.when(left, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    prefix, middle = F.substr(body, F.lit(1), first), F.substr(body, first + 1, second - first)
    suffix = F.substr(body, second + 1)
    p, s, m = map(F.lit, MARKS)
    output = F.when(form == "plain", body).when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    some = form != "plain"
    fim = F.struct(
        F.col(f"{cut}.n").alias("n"),
        form.alias("form"),
        F.when(some, F.col(f"{cut}.first")).alias("prefix_chars"),
        F.when(some, F.col(f"{cut}.second") - F.col(f"{cut}.first")).alias("middle_chars"),
        output.alias("output"),
    )
    return rows.select(*[c for c in docs.columns if c.lower() != "fim"], fim.alias("fim"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output of a form."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    found = fill_middle(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col("fim.output"), F.col("fim.form")
    return found.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(restored(output, form), 256).alias("restored_sha256"))
