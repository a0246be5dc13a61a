"""Fill-in-middle, periodic runs and SuperMinHash groups against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavemill.llm import common, fill_middle, periodic_runs, super_minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, node long, runs int, fim int, n string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.integers(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    texts = [prose(rng, int(rng.integers(1, 120))) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + " tail", texts[2].upper().replace("W", "w"), texts[3].replace("w", "W")]
    texts += [None, "", " \n\t ", "one", "One", "one two", "one  TWO", "one two three", "É é naïve ﬁ 漢字 words", "é" * 9, "a<P>b", "x <S> y", "<M>", "\x1c\x85  a"]
    texts += ["go " * 50, "a b " * 9 + "c", "a b c d e f g h i j " * 5 + "tail", prose(rng, 30) + " again and " * 7, "x y x y x y", "q " * 5, "one line here\n" * 30]
    texts += [prose(rng, 12) + " " + " ".join([prose(rng, 9)] * 4) + " " + prose(rng, 3), prose(rng, 6000), prose(rng, 3000, 3)]
    base = prose(rng, 150)
    for k in range(20):  # near copies of one text
        words = base.split()
        words[(7 * k) % 150] = f"changed{k}"
        texts.append(" ".join(words))
    out = [(k, t, "s", k, 1, 2, "x") for k, t in enumerate(texts)]
    out += [out[3], out[3], (None, texts[5], None, None, None, None, None), (None, None, "s", None, None, None, None), (None, "only here without an id", None, 1, 1, 1, "y")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- fill in the middle ------------------------------------------------------


def fim_by_hand(id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if id is None else id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (id, n, "plain", None, None, sha(text), sha(text))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    spm = h[3] % 100 < 20
    output = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return (id, n, "spm" if spm else "psm", len(p), len(m), sha(output), sha(text))


def fim_rows(docs):
    out = fill_middle.fill_middle(docs)
    text, form = F.col("fim.output"), F.col("fim.form")
    return [tuple(r) for r in out.select("doc_id", "fim.n", form, "fim.prefix_chars", "fim.middle_chars", F.sha2(text, 256), F.sha2(fill_middle.restored(text, form), 256)).collect()]


@pytest.mark.parametrize("bound, salt_rows", [(500_000, 1000), (0, 1)])
def test_fill_middle(spark, docs, rows, empty, bound, salt_rows, monkeypatch):
    monkeypatch.setattr(fill_middle, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(fill_middle, "SALT_ROWS", salt_rows)
    found = fim_rows(docs)
    assert sorted(found, key=str) == sorted([fim_by_hand(r[0], r[1]) for r in rows], key=str)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    out = fill_middle.fill_middle(docs)
    assert out.columns == [c for c in docs.columns if c != "fim"] + ["fim"]
    assert fill_middle.fill_middle(empty).count() == 0


def test_only_texts_that_occur_twice_are_indexed_and_lists_need_equal_content(spark, docs, rows, monkeypatch):
    texts = [r[1] for r in rows]
    got = fill_middle.with_boundaries(docs.filter("text is not null"), "text", "list").collect()
    assert all((r["list"] is not None) == (texts.count(r.text) > 1) for r in got)
    # all texts share one hash and one size: only equal ones may share a list
    monkeypatch.setattr(fill_middle.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    monkeypatch.setattr(fill_middle.F, "octet_length", lambda c: F.lit(1))
    assert sorted(fim_rows(docs), key=str) == sorted([fim_by_hand(r[0], r[1]) for r in rows], key=str)


@given(st.lists(st.text("aB1 é漢\U0001f600\n", max_size=40), max_size=6))
@settings(max_examples=80, deadline=None)
def test_elias_fano_selects_every_boundary(texts):
    ends, cuts = fill_middle.token_ends(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        want = [0]
        for token in re.findall(r"[A-Za-z]+|[^A-Za-z]", text):
            want.append(want[-1] + len(token))
        packed = fill_middle.pack(ends[cuts[k] : cuts[k + 1]])
        assert fill_middle.count(packed) == len(want) - 1
        assert [fill_middle.select(packed, j) for j in range(len(want))] == want


@given(st.lists(st.integers(1, 5000), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_elias_fano_of_wide_gaps(gaps):
    ends = np.cumsum(gaps)
    packed = fill_middle.pack(ends)
    assert [fill_middle.select(packed, j + 1) for j in range(len(ends))] == ends.tolist()


# --- periodic runs -----------------------------------------------------------


def runs_by_hand(words):
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            part = words[i : i + size]
            if size >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.add((i, size, q))
            i = j + 1
    return sorted(found)


def periodic_by_hand(id, text, change):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(id).encode())
    if change and id is not None and h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_hand(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (id, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone))


@pytest.mark.parametrize("change", [None, periodic_runs.looped])
def test_periodic_runs(docs, rows, empty, change):
    found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs, change=change).collect()]
    want = [periodic_by_hand(r[0], r[1], change) for r in rows]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert sum(bool(r[2]) for r in want) > 6
    assert periodic_runs.periodic_runs(empty).count() == 0


@given(st.lists(st.sampled_from("abc"), max_size=70), st.integers(1, 9), st.integers(0, 7))
@settings(max_examples=300, deadline=None)
def test_automaton_finds_all_runs(words, period, times):
    words = words + words[-period:] * times + words[:9]
    assert periodic_runs.runs_of(words) == runs_by_hand(words)


@given(st.lists(st.lists(st.sampled_from(["a", "b", "cc", "d"]), max_size=50), max_size=5), st.integers(1, 14), st.integers(3, 6))
@settings(max_examples=100, deadline=None)
def test_stretches_hold_all_runs(texts, period, times):
    texts = [t + [f"u{k}" for k in range(period)] * times + t[:7] for t in texts]
    _, found = periodic_runs._found(pa.array([" ".join(t) for t in texts], pa.string()))
    assert [found.get(k, []) for k in range(len(texts))] == [runs_by_hand(t) for t in texts]


def test_ordered_sets_of_many_blocks(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 4)
    rng = np.random.default_rng(2)
    order = rng.permutation(300).tolist()
    ends = periodic_runs.Ends(order[0])
    for k, x in enumerate(order[1:], 2):
        ends.add(x)
        have = sorted(order[:k])
        at = have.index(x)
        assert ends.around(x) == (have[at - 1] if at else None, have[at + 1] if at + 1 < k else None)
    assert list(ends) == sorted(order) and ends.size == 300
    words = list("ab" * 200 + "c" + "a" * 90 + "xyz" * 50)
    assert periodic_runs.runs_of(words) == runs_by_hand(words)


def test_a_megabyte_of_one_period(spark):
    rng = np.random.default_rng(4)
    text = "start " + " ".join(prose(rng, 1000, 10**6).split() * 150) + " end " + "no " * 60_000
    assert len(text) > 1 << 20
    found = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in found.runs] == [(1, 150_000, 1000), (150_002, 60_000, 1)]
    assert len(found.collapsed.split()) == 1003


# --- SuperMinHash ------------------------------------------------------------


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


def groups_by_hand(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(r[0], least.get(find(k), r[0]))
    out = []
    for k, r in enumerate(rows):
        component = least.get(find(k)) if sets[k] else r[0]
        out.append((r[0], len(sets[k]), component, r[0] == component))
    return out


def found_groups(docs):
    return sorted([tuple(r) for r in super_minhash.near_duplicate_groups(docs).collect()], key=str)


@pytest.mark.parametrize("block, bound", [(512, 500_000), (3, 0)])
def test_groups(docs, rows, empty, block, bound, monkeypatch):
    monkeypatch.setattr(super_minhash, "BLOCK", block)
    monkeypatch.setattr(super_minhash, "BROADCAST_ROWS", bound)
    assert found_groups(docs) == sorted(groups_by_hand(rows), key=str)
    assert super_minhash.near_duplicate_groups(empty).count() == 0


@pytest.mark.parametrize("block", [512, 5])
def test_groups_of_chains_at_the_threshold(spark, block, monkeypatch):
    monkeypatch.setattr(super_minhash, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = []
    for base in range(6):
        words = prose(rng, 60 + 20 * base).split()
        for _ in range(25):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            words[int(rng.integers(len(words)))] = f"n{rng.integers(10**6)}"  # a chain: its ends are not alike
            if rng.random() < 0.3:
                words.append("end")
            if rng.random() < 0.1:
                words = prose(rng, 70).split()
    rng.shuffle(rows)
    rows = [(int(a), str(b)) for a, b in rows]
    want = groups_by_hand(rows)
    assert len({r[2] for r in want}) > 6
    assert found_groups(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(want, key=str)


@pytest.fixture
def kept_files(spark, monkeypatch):
    """Partitions, so files, of each frame that is kept, with 40 shuffle partitions that nothing merges."""
    change = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in change}
    files, plain = [], common.durable

    def durable(*args):
        found = plain(*args)
        files.append(found.rdd.getNumPartitions())
        return found

    monkeypatch.setattr(common, "durable", durable)
    for key, value in change.items():
        spark.conf.set(key, value)
    yield files
    for key, value in before.items():
        spark.conf.set(key, value)


def test_groups_keep_few_files(docs, rows, kept_files):
    assert found_groups(docs) == sorted(groups_by_hand(rows), key=str)
    assert len(kept_files) > 8
    assert sum(n > 4 for n in kept_files) <= 4  # what units compare is dealt over all partitions


def test_the_index_of_texts_is_kept_in_one_file(docs, rows, kept_files):
    assert sorted(fim_rows(docs), key=str) == sorted([fim_by_hand(r[0], r[1]) for r in rows], key=str)
    assert kept_files == [1] * len(kept_files) and kept_files


def slow_signature(elements, size):
    """SuperMinHash of one set as it is defined, without early stopping."""
    from wavemill.llm.common import mix64

    out = [2**32 - 1] * size
    for e in elements.tolist():
        order = list(range(size))
        for j in range(size):
            draw = int(mix64(np.array([(e + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            k = j + ((draw & 0xFFFFFFFF) * (size - j) >> 32)
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], j << 24 | draw >> 40)
    return out


def test_early_stopping_changes_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 2, 5, 40, 0, 300])
    found, cuts = rng.integers(0, 2**63, sizes.sum()).astype(np.uint64), np.concatenate([[0], np.cumsum(sizes)])
    want = [slow_signature(found[a:b], 32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert super_minhash.signatures(found, cuts, 32).tolist() == want
    monkeypatch.setattr(super_minhash, "ELEMENTS", 30)
    assert super_minhash.signatures(found, cuts, 32).tolist() == want


def test_signatures_estimate_with_less_variance_than_independent_registers():
    rng = np.random.default_rng(5)
    size, errors = 64, []
    for _ in range(400):
        x = rng.integers(0, 2**63, 60).astype(np.uint64)  # 40 of 60 shared by both
        a, b = super_minhash.signatures(np.concatenate([x[:50], x[10:]]), np.array([0, 50, 100]), size)
        errors.append((a == b).mean() - 40 / 60)
    independent = (40 / 60) * (20 / 60) / size
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.85 * independent


# --- co-training -------------------------------------------------------------


def test_bounds_are_by_rank_in_what_the_other_view_allows():
    from wavemill.llm import quality_classifier as q

    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(0, 80))
        label = rng.integers(0, 2, n)
        scores, other = np.round(rng.normal(size=n) + label, 1), rng.normal(size=n)
        low, high = q.bounds(scores, label, other, 0.4, 0.8, 5)
        for value, bound in ((1, high), (0, low)):
            ok = [k for k in range(n) if (1 / (1 + np.exp(-other[k])) if value else 1 - 1 / (1 + np.exp(-other[k]))) > 0.4]
            want = np.inf if value else -np.inf
            for t in sorted({scores[k] for k in ok}, reverse=not value):
                beyond = [k for k in ok if (scores[k] >= t if value else scores[k] <= t)]
                if len(beyond) >= 5 and sum(label[k] == value for k in beyond) >= 0.8 * len(beyond):
                    want = t
                    break
            assert bound == want


def test_exchange_counts_what_a_plain_loop_counts(spark):
    from wavemill.llm import quality_classifier as q

    rng = np.random.default_rng(5)
    fits = [rng.normal(size=21), rng.normal(size=11)]
    docs = [[sorted(set(rng.integers(0, size, int(rng.integers(0, 8))).tolist())) for size in (20, 10)] for _ in range(300)]
    sure = [(-0.7, 0.9), (-np.inf, 0.5)]
    packed = [tuple(np.array(v, np.int32).tobytes() for v in d) for d in docs]
    found = q.exchange(spark.createDataFrame(packed, "word binary, meta binary").repartition(4), fits, sure, 0.4)
    for k in (0, 1):
        want = np.zeros((2, len(fits[k])))
        for d in docs:
            s = [sum(fits[v].astype(np.float32)[c] for c in d[v]) + fits[v].astype(np.float32)[-1] for v in (0, 1)]
            p = 1 / (1 + np.exp(-s[k]))
            for value, sees in ((0, s[1 - k] <= sure[1 - k][0] and 1 - p > 0.4), (1, s[1 - k] >= sure[1 - k][1] and p > 0.4)):
                if sees:
                    want[value, -1] += 1
                    want[value, d[k]] += 1
        assert (found[k].bad == want[0, :-1]).all() and (found[k].good == want[1, :-1]).all() and (found[k].n_bad, found[k].n_good) == tuple(want[:, -1])


def test_rounds_are_told_and_end_when_nothing_changes(spark):
    from wavemill.llm import quality_classifier as q

    rng = np.random.default_rng(9)
    good = rng.integers(0, 2, 4000)
    rows = [(k, " ".join(f"{'g' if rng.random() < 0.75 else 'b'}{rng.integers(60)}" if y else f"{'b' if rng.random() < 0.75 else 'g'}{rng.integers(60)}" for _ in range(12)), "web" if (rng.random() < 0.97) == y else "feed", "en") for k, y in enumerate(good.tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    labels = spark.createDataFrame([(k, int(good[k]), 0) for k in range(800)], "doc_id long, quality int, toxic int")
    model = q.train(docs, labels)
    assert model.rounds and all(t["good"] + t["bad"] > 0 for t in model.rounds[:1])
    by_round = [model.rounds[i : i + 2] for i in range(0, len(model.rounds), 2)]
    assert all(any(t["taken"] for t in r) for r in by_round[:-1])  # a round that changes nothing is the last
    assert all(t["taken"] == (t["loss"] < t["loss_before"]) for t in model.rounds)
    kept = {r.doc_id: r.kept for r in q.score(docs, model).collect()}
    assert np.mean([kept[k] == bool(good[k]) for k in range(800, 4000)]) > 0.85
