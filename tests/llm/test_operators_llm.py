"""The text operators on odd tables and against brute-force versions."""

import collections
import hashlib
import html
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jetlake.llm import (
    chat_format, common, components, decontamination, exact_dedup, html_extract, minhash_dedup, pii, sentencepiece_codec,
    substring_dedup, token_counts, toxicity, unigram)
from jetlake.llm.common import shingle_set, word_hashes

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 997}x{k % 89}" for k in range(30_000))


def words(seed, count):
    pick = random.Random(seed)
    return [f"{pick.choice('bcdfg')}{pick.choice('aeiou')}{pick.randrange(10**4)}" for _ in range(count)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a very long text, near copies, clashing columns."""
    base = words(1, 200)
    near = base[:100] + ["changed"] + base[101:]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, " ".join(base)), (5, " ".join(base)), (5, " ".join(base)),
            (6, "  ".join(near)), (7, LONG), (8, LONG.upper()), (None, " ".join(base)), (None, None), (9, "one two"),
            (10, "One  two"), (11, "▁ über \U0001F600 mail a.b@c.de +49 (30) 123456 10.0.0.1"), (12, " ".join(words(2, 90)))]
    rows = [(i, t, "en", None, 0) for i, t in rows]
    return spark.createDataFrame(rows, DOC).withColumns(
        {"id": F.lit("x"), "label": F.lit(1), "digest": F.lit(2), "kept": F.lit("k"), "file": F.lit("f"), "row": F.lit("r")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def by_id(df, name="doc_id"):
    found = collections.defaultdict(list)
    for row in df.collect():
        found[row[name]].append(row)
    return found


def test_exact(odd, empty):
    rows = by_id(exact_dedup.deduplicate(odd))
    group = {4, 5, None}
    # spaces differ from the near copy only; rows 4, 5, 5 and one without id are equal
    assert {r.group_size for i in (4, 5) for r in rows[i]} == {4}
    assert [r.keep_id for r in rows[4]] == [4] and [r.kept for r in rows[4]] == [True]
    assert not any(r.kept for r in rows[5]) and len(rows[5]) == 2
    assert sorted(r.kept for i in (1, 2, 3) for r in rows[i]) == [False, False, True] and rows[3][0].kept  # most characters
    assert group and exact_dedup.deduplicate(empty).count() == 0
    kept = exact_dedup.kept_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for found in rows.values() for r in found)


def test_exact_checks_bytes(odd):
    """A digest of no bytes puts all rows into one group; the bytes divide it."""
    plain = by_id(exact_dedup.deduplicate(odd))
    short = by_id(exact_dedup.deduplicate(odd, digest_bytes=0))
    for key in plain:
        assert sorted((r.keep_id, r.group_size, r.kept) for r in plain[key] if key) == \
            sorted((r.keep_id, r.group_size, r.kept) for r in short[key] if key)


def test_near(odd, empty):
    rows = by_id(minhash_dedup.near_duplicates(odd))
    assert {r.component_id for i in (4, 5, 6) for r in rows[i]} == {4}
    assert rows[8][0].component_id == 7 and not rows[8][0].kept
    assert rows[10][0].component_id == 9 and rows[9][0].n_shingles == 1
    assert all(rows[i][0].n_shingles == 0 and rows[i][0].kept for i in (1, 2, 3))
    assert all(r.component_id is None and r.kept for r in rows[None])
    assert minhash_dedup.near_duplicates(empty).count() == 0
    assert minhash_dedup.kept_documents(odd).columns == odd.columns


def test_near_against_all_pairs(spark):
    """A family with edits around the threshold: components equal those of all pairs."""
    base, pick, texts = words(3, 150), random.Random(4), []
    for k in range(120):
        text = list(base)
        for _ in range(pick.randrange(5)):
            text[pick.randrange(len(text))] = f"e{pick.randrange(40)}"
        texts.append(" ".join(text))
    sets = [set(shingle_set(t).tolist()) for t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {k: root(k) for k in range(len(texts))}


def test_min_max_signature_is_unbiased():
    pick = np.random.default_rng(5)
    pool = pick.integers(0, 2**63, 1150).astype(np.uint64)
    a, b = pool[:1000], pool[150:]
    share = np.mean(minhash_dedup.min_max_signature(a, 2000) == minhash_dedup.min_max_signature(b, 2000))
    assert abs(share - 850 / 1150) < 0.04


def test_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.label for r in components.components(chain).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_passages(spark, odd, empty):
    passage, other = words(6, 60), words(7, 55)
    texts = {1: words(8, 40) + passage + words(9, 30), 2: passage + words(10, 80), 3: words(11, 200),
             4: words(12, 10) + passage[:20] + ["edit"] + passage[21:] + words(13, 5), 5: words(14, 70) + other, 6: other + words(15, 20),
             7: words(16, 60) + passage[:40]}
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    rows = substring_dedup.shared_passages(docs).collect()
    pairs = {(r.doc_id, r.other_id) for r in rows}
    assert (2, 1) in pairs and (6, 5) in pairs and (4, 1) in pairs and not {3, 7} & {i for p in pairs for i in p}
    whole = next(r for r in rows if (r.doc_id, r.other_id) == (2, 1))
    assert whole.start_word == 0 and whole.end_word >= 60 and whole.other_start_word == 40
    found = {(r.doc_id, r.other_id) for r in substring_dedup.shared_passages(odd).collect()}
    assert (5, 4) in found and (6, 4) in found and (8, 7) in found and not any(12 in p for p in found)
    assert substring_dedup.shared_passages(empty).count() == 0


def test_passages_with_an_inserted_word(spark):
    rows = []
    for n, size in enumerate((50, 60, 70, 80)):
        passage = words(300 + n, size)
        cut = size // 2
        rows += [(10 * n, " ".join(words(400 + n, 40) + passage + words(500 + n, 40))),
                 (10 * n + 1, " ".join(words(600 + n, 30) + passage[:cut] + ["inserted"] + passage[cut:] + words(700 + n, 50))),
                 (10 * n + 2, " ".join(words(800 + n, 30) + passage[:cut] + passage[cut + 12:] + words(900 + n, 50)))]
    found = {(r.doc_id, r.other_id): r for r in substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, size in enumerate((50, 60, 70, 80)):
        assert found[10 * n + 1, 10 * n].start_word == 30 and found[10 * n + 1, 10 * n].end_word == 31 + size
        assert found[10 * n + 1, 10 * n].other_start_word == 40
    assert (2, 0) not in found  # 12 of 50 words missing: not similar enough


def test_staged_tables_leave_settings_as_they_were(spark):
    before = {key: spark.conf.get(key, None) for key in common.STAGING}
    assert common.staged(spark.range(10).repartition(3), "numbers").count() == 10
    assert {key: spark.conf.get(key, None) for key in common.STAGING} == before


def test_passages_whose_first_holder_has_less(spark):
    rows = []
    for n in range(40):
        passage = words(1000 + n, 60)
        edited = passage[:25] + ["inserted"] + passage[25:]
        rows += [(10 * n, " ".join(words(1100 + n, 30) + passage[6:46] + words(1200 + n, 30))),  # too little of it
                 (10 * n + 1, " ".join(words(1300 + n, 40) + passage + words(1400 + n, 20))),
                 (10 * n + 2, " ".join(words(1500 + n, 10) + edited + words(1600 + n, 70)))]
    found = {(r.doc_id, r.other_id) for r in substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(10 * n + 2, 10 * n + 1) for n in range(40)}


def test_passages_around_a_frequent_line(spark):
    line, rows, linked = words(2000, 40), [], set()
    for n in range(24):  # the line alone is no passage
        rows.append((n, " ".join(words(2100 + n, 40) + line + words(2200 + n, 40))))
    for n in range(6):  # with what surrounds it here it is one, a word of which differs
        head, tail = words(2300 + n, 8), words(2400 + n, 8)
        for k in range(2):
            rows.append((100 + 2 * n + k, " ".join(words(2500 + 2 * n + k, 40) + head + line[:20 + n] + [f"edit{n}{k}"] + line[21 + n:] + tail + words(2600 + 2 * n + k, 40))))
        linked.add((101 + 2 * n, 100 + 2 * n))
    found = {(r.doc_id, r.other_id) for r in substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == linked


def test_frequent_passages_are_connected(spark):
    passage = words(2700, 70)
    rows = [(n, " ".join(words(2800 + n, 30) + passage[:10 + 5 * (n % 5)] + [f"edit{n % 5}"] + passage[11 + 5 * (n % 5):] + words(2900 + n, 30))) for n in range(40)]
    rows += [(100 + n, " ".join(words(3000 + n, 30) + passage[:30] + words(3100 + n, 30))) for n in range(5)]
    labels = list(range(105))
    for row in substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        old, new = labels[row.doc_id], labels[row.other_id]
        labels = [new if label == old else label for label in labels]
    assert len(set(labels[:40])) == 1 and len(set(labels[100:])) == 5 and labels[0] not in labels[100:]


def test_lines_from_equal_tokens_are_those_of_each_line():
    for seed, vocabulary in ((1, 400), (2, 40), (3, 6)):  # the last one has too many equal tokens and goes line by line
        pick = np.random.default_rng(seed)
        left = pick.integers(0, vocabulary, 300).astype(np.uint64)
        right = np.concatenate([left[40:160], pick.integers(0, vocabulary, 30).astype(np.uint64), left[100:230], left[:20]])
        right[[5, 60, 61, 200]] = 10**6
        order, tokens = substring_dedup.by_token(left)
        lines = substring_dedup.Lines(left, right, order, np.searchsorted(tokens, right, "left"), np.searchsorted(tokens, right, "right"))
        assert lines.whole == (vocabulary > 6)
        shifts, places = (v.ravel() for v in np.meshgrid(np.arange(-len(right), len(left)), np.arange(len(right))))
        want = []
        runs = {s: substring_dedup.shared_runs(left, right, s) for s in np.unique(shifts).tolist()}
        for shift, place in zip(shifts.tolist(), places.tolist()):
            want.append(next((r for r in runs[shift] if r[0] <= place < r[1]), (-1, -1)))
        assert any(w[0] >= 0 for w in want) and list(zip(*(v.tolist() for v in lines.covering(shifts, places)))) == want


def test_texts_of_many_pairs_are_hashed_once(monkeypatch):
    hashed = []
    monkeypatch.setattr(substring_dedup, "word_hashes", lambda text: hashed.append(text) or common.word_hashes(text))
    texts = {k: " ".join(words(3300 + k, 80)) for k in range(4)}
    pairs = [(a, b) for a in texts for b in texts if a < b]
    rows = pa.RecordBatch.from_arrays([*(pa.array(v) for v in zip(*pairs)), pa.array([[]] * len(pairs), pa.list_(pa.int64())),
                                       *(pa.array([texts[p[k]] for p in pairs]) for k in (0, 1))], names=["a", "b", "hits", "ta", "tb"])
    assert sum(batch.num_rows for batch in substring_dedup._verified([rows])) == 0
    assert sorted(hashed) == sorted(texts.values())


def test_words_of_many_texts_are_hashed_together():
    pick = random.Random(5)
    texts = ["", " ", "a", "A\x0bB\x0c\x1c c\x85d e", "\udcff q", " ".join("k" * n for n in range(70))]
    texts += ["".join(pick.choice("aB \n\té日\x00\x08\x0e") for _ in range(pick.randrange(90))) for _ in range(500)]
    hashes, counts = common.joined_word_hashes(texts)
    want = [common.word_hashes(text) for text in texts]
    assert counts.tolist() == [len(w) for w in want] and (hashes == np.concatenate(want)).all()
    tokens, sizes = substring_dedup.joined_tokens(texts)
    want = [common.shingle_hashes(w) if len(w) >= 5 else w[:0] for w in want]
    assert sizes.tolist() == [len(w) for w in want] and (tokens == np.concatenate(want)).all()
    assert [len(part) for part in (*common.joined_word_hashes([]), *substring_dedup.joined_tokens(["a", ""]))] == [0, 0, 0, 2]


def test_windows_of_joined_texts_are_those_of_each():
    pick = np.random.default_rng(1)
    for top in (4, 30, 2**60):
        sizes = np.array([0, 3, 60, 9, 10, 11, 0, 200, 1])
        values = pick.integers(0, top, sizes.sum()).astype(np.uint64)
        first, want = np.cumsum(sizes) - sizes, []
        for start, size in zip(first.tolist(), sizes.tolist()):
            want += [tuple(start + x for x in window) for window in substring_dedup.compact_windows(values[start:start + size], 10)]
        assert sorted(zip(*(v.tolist() for v in substring_dedup.windows_of(values, sizes, 10)))) == sorted(want)


def test_hits_of_a_slice_are_its_own():
    window = pa.list_(pa.struct([(name, pa.int32()) for name in "clr"]))
    kind = pa.list_(pa.struct([("key", pa.int64()), ("many", pa.bool_()), ("wa", window), ("wb", window)]))
    side = lambda n: [{"c": n + k, "l": n, "r": n + 9} for k in range(1 + n % 3)]
    lists = pa.array([[{"key": 10 * n + k, "many": k == 1, "wa": side(n), "wb": side(n + k)} for k in range(1 + n % 2)] for n in range(300)], kind)
    whole, part = substring_dedup.Hits(lists), substring_dedup.Hits(lists.slice(130, 64))
    assert len(part.arrays[1]) == 96 and len(part.arrays[3][1]) == sum(len(side(n)) * (1 + n % 2) for n in range(130, 194))
    for n in range(64):
        assert all((x == y).all() for x, y in zip(whole.of(130 + n), part.of(n)))


def test_prefixes_are_those_of_each_member(monkeypatch):
    pick, rows = np.random.default_rng(2), []
    for member in range(12):  # some have places of several tokens, some too few
        places = pick.permutation(160)[:20 + 12 * member]
        tokens = np.unique(pick.integers(-2**60, 2**60, len(places)))
        owner = np.concatenate([np.arange(len(tokens)), pick.integers(0, len(tokens), len(places) - len(tokens))])
        rows += [(member // 4, member, int(token), np.sort(places[owner == k]).astype(np.int32), int(pick.integers(2, 5))) for k, token in enumerate(tokens)]
    keys = np.array([r[0] for r in rows])
    table = pa.RecordBatch.from_arrays(
        [pa.array(np.array([r[2] for r in rows]) ^ substring_dedup._salt(keys)), pa.array(keys), pa.array([r[1] for r in rows]),
         pa.array([r[3].tobytes() for r in rows], pa.binary()), pa.array([r[4] for r in rows])], names=["group", "key", "doc_id", "places", "n"])
    want = set()
    for member in range(12):
        own = sorted((r[4], r[2], tuple(r[3])) for r in rows if r[1] == member)
        at = sorted((place, rank) for rank, r in enumerate(own) for place in r[2])
        chosen = substring_dedup.prefix(*(np.array(v, np.int64) for v in zip(*at)))
        want |= {(member, own[k][1]) for k in chosen.tolist()}
    assert want
    for size in (1, 300, 20_000):
        monkeypatch.setattr(substring_dedup, "MEMBER_ROWS", size)
        found = [r for b in substring_dedup._prefixes(table.slice(k, 7) for k in range(0, len(rows), 7)) for r in b.to_pylist()]
        assert len(found) == len(want) and {(r["doc_id"], r["group"] ^ int(substring_dedup._salt(np.array([r["key"]]))[0])) for r in found} == want


def test_labels_after_further_links(spark):
    pick = random.Random(8)
    links = lambda rows: spark.createDataFrame(rows, "a long, b long")
    rows = [(pick.randrange(80), pick.randrange(80)) for _ in range(50)]
    labels = components.components(links(rows[:25]))
    for low, high in ((25, 40), (40, 50)):
        labels = components.merged(labels, links(rows[low:high]))
        assert sorted(labels.collect()) == sorted(components.components(links(rows[:high])).collect())
    assert sorted(components.merged(labels, links([])).collect()) == sorted(labels.collect())


def test_pairs_of_a_short_common_line_send_no_texts(spark, monkeypatch):
    line, shared = words(40, 20), words(41, 60)
    edited = shared[:30] + ["put"] + shared[30:]
    rows = [(n, " ".join(words(300 + n, 60) + line + words(400 + n, 60))) for n in range(60)]
    rows += [(100, " ".join(words(500, 30) + shared + words(501, 30))), (101, " ".join(words(502, 50) + edited)),
             (102, " ".join(shared + words(503, 40))), (102, " ".join(shared + words(503, 40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sent, verified = [], substring_dedup.verified
    monkeypatch.setattr(substring_dedup, "verified", lambda docs, pairs: sent.append(
        {(r.a, r.b) for r in pairs.select("a", "b").collect()}) or verified(docs, pairs))
    monkeypatch.setattr(substring_dedup, "PART_MEMBERS", 1)
    found = {(r.other_id, r.doc_id) for r in substring_dedup.shared_passages(docs).collect()}
    assert found == {(100, 101), (100, 102), (101, 102)}
    assert sent[0] == found and all(not pairs for pairs in sent[1:])


def test_common_tokens_around_windows_keep_pairs():
    side = pa.list_(pa.struct([(name, pa.binary()) for name in ("ta", "tb", "rb")]))

    def kept(*hits):
        hits = [{"ta": a.tobytes(), "tb": b.tobytes(), "rb": np.array([place, len(b)], np.int32).tobytes()} for a, b, place in hits]
        batch = pa.RecordBatch.from_pylist([{"a": n, "b": n + 1, "regions": hits} for n in range(3)],
                                           pa.schema([("a", pa.int64()), ("b", pa.int64()), ("regions", side)]))
        return [r.num_rows for r in substring_dedup._likely([batch, batch.slice(1)])]
    one, other = np.arange(41, dtype=np.uint16), np.arange(100, 150, dtype=np.uint16)
    assert kept((one, one, 7)) == [3, 2] and kept((one, one[:40], 7)) == [0, 0] and kept((one, other, 7)) == [0, 0]
    assert kept((one[:20], other, 300), (one[20:], one, 7)) == [3, 2]  # a passage may lie across two windows
    assert kept((one, one[:40], 7), (one, one[:40], 7)) == [0, 0]  # a place counts once
    assert kept((one, one[:40], 7), (one, one[:40], 8)) == [3, 2]


def test_prefix_of_similar_passages_meets():
    pick = np.random.default_rng(8)
    for _ in range(50):
        a = pick.permutation(91)
        b = a.copy()
        at = int(pick.integers(0, 46))
        b[:at], b[at + 46:] = 1000 + np.arange(at), 2000 + np.arange(45 - at)
        b[at + pick.choice(46, 5, replace=False)] = 3000 + np.arange(5)
        shared = [np.flatnonzero(np.isin(x, y)) for x, y in ((a, b), (b, a))]
        assert set(substring_dedup.prefix(shared[0], a[shared[0]])) & set(substring_dedup.prefix(shared[1], b[shared[1]]))


def test_aligned_passages_have_the_similarity():
    pick = np.random.default_rng(4)
    for size in (50, 70, 120, 300):
        a = substring_dedup.shingle_hashes(pick.integers(0, 2**60, size).astype(np.uint64))
        assert substring_dedup.aligned_passages(a, a) == [(0, len(a), 0, len(a))]
        assert substring_dedup.aligned_passages(a[:46], pick.integers(0, 2**60, 60).astype(np.uint64)) == []


def test_compact_windows():
    pick = np.random.default_rng(0)
    for n, top in ((5, 9), (46, 2**60), (120, 30), (300, 2**60)):
        values = pick.integers(0, top, n).astype(np.uint64)
        want = []
        for c in range(n):
            left, right = c, c
            while left > 0 and values[left - 1] > values[c]:
                left -= 1
            while right < n - 1 and values[right + 1] >= values[c]:
                right += 1
            if right - left + 1 >= 10:
                want.append((left, c, right))
        assert sorted(substring_dedup.compact_windows(values, 10)) == sorted(want)


def test_contained_items(spark, odd, empty):
    item, small, tiny = words(20, 40), words(21, 9), ["one", "two"]
    benchmark = spark.createDataFrame(
        [(1, " ".join(item)), (1, " ".join(item)), (2, " ".join(small)), (3, " ".join(tiny)), (4, None), (5, " ".join(words(22, 300))), (None, "x")],
        "item_id long, text string").withColumn("doc_id", F.lit(3))
    texts = {1: words(23, 5000) + item[:38] + words(24, 9000), 2: words(25, 50) + small, 3: tiny, 4: item[:20] + words(26, 20), 5: None,
             6: words(22, 300)[:250], 7: words(27, 300)}
    docs = spark.createDataFrame([(k, v and " ".join(v)) for k, v in texts.items()], "doc_id long, text string").withColumn("item_id", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontamination.contained_items(docs, benchmark).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (6, 5)}
    blocks = decontamination.contained_items(docs, benchmark, block_chars=300)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == got
    assert {r.doc_id for r in decontamination.clean_documents(docs, benchmark).collect()} == {4, 5, 7}
    assert decontamination.contained_items(empty, benchmark).count() == 0
    assert decontamination.contained_items(docs, benchmark.limit(0)).count() == 0
    assert {(r.doc_id, r.item_id) for r in decontamination.contained_items(odd, benchmark).collect()} == {(9, 3), (10, 3)}


def test_codec_round_trip(odd, empty):
    encoded = sentencepiece_codec.encode(odd)
    texts = collections.Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert collections.Counter((r.doc_id, r.text) for r in sentencepiece_codec.decode(encoded).collect()) == texts
    rows = by_id(sentencepiece_codec.digests(odd, chunk=300))
    counts = by_id(token_counts.token_counts(odd))
    assert {k: sorted(r.n_tokens for r in v) for k, v in rows.items()} == {k: sorted(r.n_tokens for r in v) for k, v in counts.items()}
    assert rows[7][0].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert sentencepiece_codec.digests(empty).count() == 0 and token_counts.token_counts(empty).count() == 0


def test_texts_are_encoded_and_digested_by_one_worker(odd, capsys):
    sentencepiece_codec.digests(odd, chunk=300).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 2  # short texts and chunks; digests add no worker to a task


def test_trie_counts_equal_segmentation(spark):
    """Shared beginnings, letters without piece, pre-tokens longer than the trie, texts cut into parts."""
    pick = random.Random(5)
    scores = {c: -2.0 - pick.random() for c in "abc "} | {
        "".join(pick.choice("abc") for _ in range(pick.randrange(2, 6))): -3 - 3 * pick.random() for _ in range(60)}
    vocabulary = unigram.Vocabulary(scores, {p: k + 256 for k, p in enumerate(scores)}, list(range(256)))
    sizes = (1, 3, 8, token_counts.DEPTH, token_counts.DEPTH + 1, 300)
    distinct = sorted({"".join(pick.choice("abc\u00e9\U0001F600") for _ in range(pick.choice(sizes))) for _ in range(600)})
    trie = token_counts.Trie(vocabulary)
    assert trie.counts(distinct) == [len(unigram.segment(u, vocabulary)) for u in distinct] and trie.counts([]) == []
    assert trie.nodes < sum(min(len(u), token_counts.DEPTH) for u in distinct)  # beginnings are scored once
    text = "".join(pick.choice("ab  ") for _ in range(500))
    cut = list(token_counts.parts(text, vocabulary, 7))
    assert len(cut) > 5 and [u for part in cut for u in unigram.units(part, vocabulary)] == unigram.units(text, vocabulary)
    docs = spark.createDataFrame([(1, "ab" * 100_000), (2, "\u00fcber " * 50_000)], "doc_id long, text string")
    want = {r.doc_id: r.n_tokens for r in sentencepiece_codec.digests(docs).collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()} == want


def test_scan_equals_the_whole():
    """Transfer matrices give the score of the undivided text, with and without places that no piece crosses."""
    pick = random.Random(1)
    scores = {c: -2.0 - pick.random() for c in "abc "} | {
        "".join(pick.choice("abc") for _ in range(pick.randrange(2, 6))): -3 - 3 * pick.random() for _ in range(60)}
    vocabulary = unigram.Vocabulary(scores, {p: k + 256 for k, p in enumerate(scores)}, list(range(256)))
    encoder = sentencepiece_codec.Encoder(vocabulary)
    for letters in ("abc", "abc  ", "abcé "):
        text = "".join(pick.choice(letters) for _ in range(400))
        whole = unigram.segment(text, vocabulary)
        for size in (7, 33, 400):
            chunks = [(text[k:k + size], text[k + size:k + size + vocabulary.longest - 1]) for k in range(0, len(text), size)]
            matrices = np.stack([sentencepiece_codec.transfer_matrix(*c, encoder) for c in chunks])
            states = sentencepiece_codec.boundary_states(matrices)
            ids = b"".join(sentencepiece_codec.encoded_chunk(*c, a, b, encoder) for c, a, b in zip(chunks, states, states[1:]))
            # pieces in another order can have the same sum, so sums and texts are compared
            value = {number: scores[piece] for piece, number in vocabulary.ids.items()}
            total = lambda numbers: sum(value.get(n, vocabulary.unknown / 2) for n in numbers)
            assert abs(total(np.frombuffer(ids, np.int32).tolist()) - total(whole)) < 1e-6
            assert encoder.decoded(ids).decode() == text


def test_segmentation_against_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = proto.ModelProto()
    with open(sentencepiece_codec.MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    vocabulary = unigram.load(sentencepiece_codec.MODEL)
    total = lambda ids: sum(library.get_score(i) for i in ids)
    for word in "Over the lazy dog unbelievable Donaudampfschifffahrt çréoi nterti whhathen mentenré".split():
        assert total(library.encode(word)) <= total(unigram.segment(" " + word, vocabulary))


def test_buckets_bound_what_sets_share(spark):
    pick, rows = np.random.default_rng(3), []
    for size in (1, 40, 200, 255, 257, 700, 6000):
        one = pick.integers(0, 2**63, size, np.uint64)
        other = np.concatenate([one[size // 10:], pick.integers(0, 2**63, size // 5, np.uint64)])
        rows.append(([*minhash_dedup.bitset(one).view(np.int64).tolist()], [*minhash_dedup.bitset(other).view(np.int64).tolist()],
                     len(np.setdiff1d(one, other)), len(np.setdiff1d(other, one))))
    rows.append((None, rows[0][1], 0, 0))
    found = spark.createDataFrame(rows, "x array<long>, y array<long>, a int, b int").select(
        "a", "b", minhash_dedup._lacking("x", "y").alias("la"), minhash_dedup._lacking("y", "x").alias("lb")).collect()
    assert all(r.la <= r.a and r.lb <= r.b for r in found)
    assert all(r.la >= r.a / 2 and r.lb >= r.b / 2 for r in found[:6])


def test_lattice_equals_single_units():
    vocabulary, pick = unigram.load(sentencepiece_codec.MODEL), random.Random(5)
    letters = "aeinrst  \u00e4\u00df\u65e5\u672c\u2581\x00\x7f\x80\u07ff\u0800\uffff\U00010000\U0010ffff\ud800"
    found = ["".join(pick.choices(letters, k=pick.randint(1, 40))) for _ in range(2000)]
    ids, scores = unigram.Lattice(vocabulary).segmented(found)
    for unit, got, score in zip(found, ids, scores):
        assert np.frombuffer(got, np.int32).tolist() == unigram.segment(unit, vocabulary)
        assert score == unigram.forward(unit, vocabulary)[0][-1]


def test_segmentation_against_enumeration():
    vocabulary = unigram.load(sentencepiece_codec.MODEL)

    def totals(text):
        if not text:
            yield 0.0
        for end in range(1, min(len(text), vocabulary.longest) + 1):
            if text[:end] in vocabulary.scores:
                for rest in totals(text[end:]):
                    yield vocabulary.scores[text[:end]] + rest

    score = {number: vocabulary.scores[piece] for piece, number in vocabulary.ids.items()}
    for text in (" the", " there", " whhathen", " erberkeit", "  two", " 4711"):
        assert sum(map(score.get, unigram.segment(text, vocabulary))) == max(totals(text))


def test_pii_base_is_the_pattern():
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def passes(kind, text):
        digits = re.sub("[^0-9]", "", text)
        return (True, all(int(p) <= 255 for p in text.split(".")) if kind == 1 else True,
                12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[kind]

    pick = random.Random(2)
    for _ in range(4000):
        text = "".join(pick.choice("ab1290.@+-() %") for _ in range(50))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, text) if passes(k, m[0]))
        assert pii.base_spans(text) == want
    pii.base_spans("a" * 300_000 + "1" * 300_000 + "@" + "+" * 1000 + "1." * 100_000)  # linear


def test_pii_field(spark, odd, empty):
    card = "4539578763621486"
    texts = [f"pay {card} now {k}" for k in range(30)] + [f"call +1 (743) 555-{k:04d} or mail u{k}@h.example.com" for k in range(30)]
    texts.append(f"both {card} 4539578763621487 end")  # the pattern takes both as one and drops it
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert rows[0].spans == f"card:4:{4 + len(card)}" and rows[30].n_phone == 1 and rows[30].n_email == 1
    assert rows[60].n_card == 0 and f"card:5:{5 + len(card)}" in rows[60].spans
    found = by_id(pii.find(odd))
    assert (found[11][0].n_email, found[11][0].n_ip, found[11][0].n_phone) == (1, 1, 1) and found[1][0].spans == ""
    assert found[1][0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(empty).count() == 0


def test_semi_markov_against_enumeration():
    text = "a1 2b"
    _, atoms = pii.regions(text)[0]
    pick = random.Random(3)
    model = pii.SemiMarkov({(kind, f): pick.uniform(-1, 1) for ends in pii.SemiMarkov().segments(text, atoms)
                            for _, features in ends for f in features for kind in range(1, 5)})
    ends = model.segments(text, atoms)

    def all_paths(end):
        if end == 0:
            yield 0.0, []
            return
        for score, path in all_paths(end - 1):
            yield score, path
        for begin, features in ends[end]:
            for kind, s in enumerate(model.scores(features), 1):
                for score, path in all_paths(begin):
                    yield score + s, [*path, (begin, end, kind)]

    assert model.best(text, atoms) == max(all_paths(len(atoms)), key=lambda x: x[0])[1]


def test_pii_regions_are_whole():
    card, model = "4539 5787 6362 1486", pii.SemiMarkov({(3, "checkTrue"): 1.0, (3, "groups4"): 1.0, (3, "ends-digit"): -2.0, (3, "endsdigit-"): -2.0})
    for before, after in (("7 " * 29, " 7" * 90), ("x" * 300 + "-", "-7" * 9), ("x-" * 119, "-" * 300), ("8 " * 500, "")):
        text = before + card + after  # across 60 and 240 atoms, behind 300 characters without a digit, in a region of 1,000 atoms
        (_, atoms), = pii.regions(text)
        assert atoms[0][0] == 0 and atoms[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(atoms, atoms[1:]))
        assert (len(before), 2, len(before) + len(card)) in pii.added_spans(text, [], model)
    assert pii.regions("no such words " * 30 + "x" * 500) == []
    assert [start for start, _ in pii.regions("a b1 c@  d2 e\t3")] == [2, 9, 14]
    assert len(pii.regions("x" * 300_000 + "1 " * 100_000)[0][1]) == 200_001  # linear
    gold = [(55, 62, 3), (118, 130, 3), (356, 368, 1), (700, 714, 2)]
    for text in ("7 " * 400, "7-" * 400):
        (_, atoms), = pii.regions(text)
        parts = list(pii.pieces(text, atoms, gold))
        assert [a for part, _ in parts for a in part] == atoms and sum(len(spans) for _, spans in parts) == len(gold)
        assert all((240 if "-" in text else 60) <= len(part) < (260 if "-" in text else 80) for part, _ in parts[:-1])


def test_pii_field_finds_what_lies_deep_in_a_word(spark):
    card = "4539578763621486"
    texts = [f"pay ,{card}, now {k}" for k in range(30)]
    texts.append("," * 300 + f"{card} 4539578763621487 end")  # the pattern takes both as one and drops it
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[30].n_card == 0 and rows[30].spans.split(",")[0] == "card:300:316"


def test_toxicity_counts_all_training_rows_apart(spark):
    pick = np.random.default_rng(8)
    many = pick.integers(0, 2**64, 300_000, dtype=np.uint64)
    ratios = toxicity.Ratios(many, np.arange(len(many), dtype=np.float32))
    assert (ratios.of(many) == np.arange(len(many))).all() and np.isnan(ratios.of(many + np.uint64(1))).all()  # none shares an entry
    letters = words(77, 4000)
    hashes = [np.unique(toxicity.grams(" ".join(letters))[k]) for k in range(3)]
    assert all(int(h.max()) > 2**60 for h in hashes)
    rows = spark.createDataFrame([("abc", 1), ("abc abd", 0)], "text string, toxic int")
    whole, one = toxicity.counts(rows), toxicity.counts(rows.where("toxic = 1"))
    left = {(r.g, r.toxic, r.ordinary) for r in toxicity.without(whole, one).collect()}
    assert left == {(r.g, r.toxic, r.ordinary) for r in toxicity.counts(rows.where("toxic = 0")).collect()}
    ids = [r.id for r in spark.range(4000).where(toxicity.remainder(F.col("id")) == 1).limit(400).collect()]
    docs = [(i, f"{' '.join(words(5000 + i, 20))} {'vilez vilest' if n % 2 else ''}") for n, i in enumerate(ids)]
    extra = [(10**6 + n, f"{' '.join(words(9000 + n, 20))} {'grabox' if n % 2 else ''}") for n in range(400)]
    frame = spark.createDataFrame(docs + extra, "doc_id long, text string")
    # only rows of remainder 1 hold the word "vilest": it is learnt although the curve is fitted on them
    marks = spark.createDataFrame([(i, n % 2) for n, (i, _) in enumerate(docs)] + [(i, n % 2) for n, (i, _) in enumerate(extra)], "doc_id long, toxic int")
    test = frame.unionByName(spark.createDataFrame([(None, "good vilez vilest vilez words"), (None, "good words only here")], "doc_id long, text string"))
    got = [r.score for r in toxicity.scores(test, marks).where("doc_id is null").orderBy("score").collect()]
    assert got[1] > got[0]


def test_toxicity(spark, odd, empty):
    pick = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 6 == 0
        text = words(1000 + k, 30) + [f"vil{pick.choice(['e', 'er', 'est', 'ish'])}{pick.choice('xyz')}" for _ in range(3 * toxic)]
        pick.shuffle(text)
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    got = {r.doc_id: r for r in toxicity.scores(docs, marks).collect()}
    held = [(got[k].predicted, y) for k, y in labels if got[k].held_out]
    assert len(held) > 60 and np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.scores(odd, marks).count() == odd.count()
    assert toxicity.scores(odd, marks.limit(0)).count() == odd.count()
    assert toxicity.scores(empty, marks).count() == 0


def test_chat(spark):
    turns = spark.createDataFrame(
        [(1, 1, "assistant", "a <b> \\ </turn>\n"), (1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x"), (2, 0, "ro>le\\", "<turn user>\n")],
        "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash")).withColumn("parts", F.lit(1))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(chat_format.text_turns(turns))).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nuser\n\nassistant\na <b> \\ </turn>\n\n") and got[1].n_turns == 3
    assert got[1].loss_sha256 == sha("a <b> \\ </turn>\n") and got[1].loss_chars == 16
    assert got[2].turns_sha256 == sha("ro>le\\\n<turn user>\n\n") and got[2].loss_chars == 0
    assert got[None].n_turns == 1
    assert chat_format.read_back(chat_format.format_turns(chat_format.text_turns(turns.limit(0)))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <", None, None), ("image", None, "a>b.png", 3), None, ("audio", None, "c.wav", 10), ("text", " end", None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat_format.PART}")
    first, second = chat_format.format_turns(turns).orderBy("turn").collect()
    assert first.segment == "<turn user>\nsee \\<<part image 768 a\\>b.png><part audio 250 c.wav> end</turn>\n"
    assert [(a.position, a.type, a.ref, a.tokens) for a in first.attachments] == [(1, "image", "a>b.png", 768), (2, "audio", "c.wav", 250)]
    assert first.part_tokens == 1018 and second.segment == "<turn assistant>\n</turn>\n"
    assert chat_format.read_segment(first.segment) == ("user", "see < end")


def test_html(spark):
    page = ("<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a>m</a><li>n</ul></nav>"
            "<header>top</header><div class='ad'>buy</div><{0}><h1>Title &amp; more</h1><p>one\n <b>two</b><br>three<p>{1}</p>"
            "<section id=comments>said</section><aside>x</aside><form>f</form><p> &lt;last&gt;</p></{0}><footer>&copy; h</footer></body></html>")
    rows = [(1, "http://a.example/x", page.format("article", "p1")), (2, None, None), (3, "http://b.example/1", page.format("div", "slot one")),
            (4, "http://b.example/2", page.format("div", "slot two")), (5, "http://b.example/3", page.format("div", "slot three")),
            (6, "::", ""), (7, "http://a.example/y", page.format("article", "p1")[:-40] + "<p>cut<a href='"), (1, "http://a.example/x", page.format("article", "p1"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("clash"))
    got = by_id(html_extract.extract(pages), "page_id")
    text = "Title & more\none two three\n{}\n<last>"
    assert [r.text for r in got[1]] == [text.format("p1")] * 2 and got[1][0].n_chars == len(text.format("p1"))
    assert got[2][0].text == "" and got[6][0].text == ""
    assert "slot two" in got[4][0].text and "buy" not in got[4][0].text and "m" not in got[4][0].text.split("\n") and "said" not in got[4][0].text
    assert got[7][0].text.startswith("Title & more")
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_wrapper_is_union_free():
    one = html_extract.wrapper_of(html_extract.parse("<ul><li>a</li></ul><p>x</p>"))
    two = html_extract.wrapper_of(html_extract.parse("<ul><li>a</li><li>b</li></ul><h2>t</h2><p>y</p>"))
    assert html_extract.expression(html_extract.aligned(one, two)) == "(ul(li(#)+) h2(text)? p(#))"


def test_pages_against_plain_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h\d)\b[^>]*>", inner.replace("<br>", " "))
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert got[row.page_id] == "\n".join(t for t in texts if t)


def test_pages_without_marked_elements(spark):
    """Constant containers around the article's place; its tags are stripped, so that only the host's wrapper knows it."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").where("html is not null").select("page_id", "html")
    rows = [(r.page_id, f"http://{r.page_id % 3}.example/{r.page_id}", r.html) for r in pages.collect()]
    around = lambda h, left, right: h.replace("<article>", f"<div><p>The motto</p></div>{left}").replace(
        "</article>", f"{right}<div><p>All rights</p></div>")
    make = lambda left, right: spark.createDataFrame(
        [(i, u, around(h, left, right)) for i, u, h in rows], "page_id long, url string, html string")
    want = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for left, right in (("<article>", "</article>"), ("<div class=x>", "</div>"), ("", "")):
        assert {r.page_id: r.text for r in html_extract.extract(make(left, right)).collect()} == want


def test_marked_elements_are_one_sign(spark):
    page = "<body><article class=related><p>teaser</p></article><div><h1>{0}</h1><p>{0} long story of the day</p></div><article><p>by us</p></article></body>"
    rows = [(k, "http://a.example/", page.format(f"n{k}")) for k in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "n1\nn1 long story of the day\nby us"


def test_copies_and_constant_headings_keep_main_text(spark):
    page = "<body><div class=story><h1>T</h1><p>{0}</p></div><div>{1}</div></body>"
    rows = [*[(k, "http://copies.example/", page.format("same", "end")) for k in range(3)],  # (a) equal pages are no template
            *[(10 + k, "http://small.example/", page.format(f"text {k}", "end")) for k in range(2)],  # a heading on all pages
            *[(20 + k, "http://parts.example/", page.format("a" * 90 + str(k), "b" * 10 + str(k))) for k in range(2)]]  # (b) nine tenths in one child
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got[1] == "T\nsame\nend" and got[10] == "T\ntext 0"
    assert got[21] == f"T\n{'a' * 90}1\n{'b' * 10}1"


def test_words():
    assert len(word_hashes("A b c\x0bd\x1ce")) == 3  # only the six characters divide words
    assert word_hashes("ÀB")[0] != word_hashes("àb")[0] and word_hashes("AB")[0] == word_hashes("ab")[0]


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
    result = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0.6 * docs.count() < result.count() < docs.count() and "n_tokens" in result.columns


def test_state_stores_do_not_stay_open(spark, monkeypatch):
    """The stores of a finished stream are closed by their tasks and share a bounded cache."""
    seen, settings = {}, exact_dedup._settings
    monkeypatch.setattr(exact_dedup, "_settings", lambda session, **values: seen.update(values) or settings(session, **values))
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(docs).collect()}
    assert found == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 1, True)}
    prefix = "spark.sql.streaming.stateStore."
    assert seen[f"{prefix}unloadOnCommit"] == "true" and int(seen[f"{prefix}rocksdb.maxMemoryUsageMB"]) <= 128
    assert all(spark.conf.get(key, None) is None for key in (f"{prefix}rocksdb.maxMemoryUsageMB", f"{prefix}rocksdb.writeBufferSizeMB"))
