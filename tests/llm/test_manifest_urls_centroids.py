"""Centroid clustering, Merkle manifest and URL filters on odd tables and against brute-force versions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jetlake.llm import centroid_clustering, merkle_manifest, url_filters
from jetlake.llm.common import staged

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("g", "pos", "n", "block", "leaf", "node", "part", "cluster", "v", "d", "host", "root", "verdict", "copy")


def clashing(df):
    """The table with other columns under names that the operators use inside."""
    return df.withColumns({name: F.lit(name) for name in CLASH})


# Merkle manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, lower=False):
    text = row[1]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    fields = [row[0], row[3], row[2], row[4], text]
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k:k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_siblings(levels, place):
    found = []
    for nodes in levels[:-1]:
        start = place // 16 * 16
        found.append((nodes[start:place], nodes[place + 1:start + 16]))
        place //= 16
    return found


def plain_manifest(rows):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[3]].append((plain_leaf(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[name] = plain_levels([leaf for leaf, _ in groups[name]])
    top = plain_levels([trees[name][-1][0] for name in names])
    found = []
    for k, name in enumerate(names):
        for place, (leaf, row) in enumerate(groups[name]):
            path = plain_siblings(trees[name], place) + plain_siblings(top, k)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = plain_leaf(row, True) if tampered else leaf
            for left, right in path:
                node = sha("".join([*left, node, *right]))
            proof = sha("".join(x for left, right in path for x in left + right))
            found.append((row[0], leaf, trees[name][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return found


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_against_plain_trees(spark):
    """A hot source of several blocks and levels, one of exactly a block, one of a block and a row, small ones, odd rows."""
    pick, rows = random.Random(5), []
    sizes = {"hot": 4_500, "block": 256, "more": 257, "run": 16, "alone": 1, "Ünder": 17, None: 40, "": 3}
    for name, size in sizes.items():
        for _ in range(size):
            rows.append((pick.randrange(10**6), pick.choice(["Text Of", "plain", "ÄB c", ""]) * pick.randrange(3), "en", name, 7))
    rows += [(None, "No Id", None, "hot", None), (5, None, None, "hot", None), (5, None, None, "hot", None), (6, "X" * 300_000, "en", "hot", 1)]
    rows += [(k, f"One {k}", "en", f"s{k:03}", k) for k in range(40)]  # more sources than a run
    docs = clashing(spark.createDataFrame(rows, DOC)).repartition(7)
    assert rows_of(merkle_manifest.manifest(docs), *MANIFEST) == sorted(plain_manifest(rows), key=repr)


def test_manifest_of_more_sources_than_a_block(spark):
    rows = [(k, f"One {k}", "en", f"s{k:03}", k) for k in range(300)]
    assert rows_of(merkle_manifest.manifest(spark.createDataFrame(rows, DOC)), *MANIFEST) == sorted(plain_manifest(rows), key=repr)


def test_manifest_of_few_rows(spark):
    one = [(3, "Only", "en", None, 4)]
    assert merkle_manifest.manifest(spark.createDataFrame(one[:0] or [], DOC)).count() == 0
    assert rows_of(merkle_manifest.manifest(spark.createDataFrame(one, DOC)), *MANIFEST) == plain_manifest(one)


def test_versions_share_untouched_nodes():
    nodes = [sha(str(k)) for k in range(200)]
    tree = merkle_manifest.Tree(nodes, True)
    before = [list(level) for level in tree.levels]
    changed = nodes[:77] + [sha("new")] + nodes[78:]
    path = tree.version(77, sha("new"))
    assert path == [merkle_manifest.Tree(changed, True).levels[k][77 // 16**k] for k in range(3)]
    assert tree.levels == before and len(path) == len(tree.levels)


# Centroid clustering

def plain_clusters(rows, count=40, rounds=5):
    kept = []
    for key, x in rows:
        if x is not None and len(x) == 64 and all(c is not None and np.isfinite(c) for c in x):
            kept.append((key, np.floor(256 * np.array(x, np.float32).astype(np.float64)).astype(np.int64)))
    hashed = sorted((sha(f"2:{k}"), v.tolist()) for k, v in kept if k is not None)[:count]
    centroids, points = [v for _, v in hashed], np.array([v for _, v in kept])
    for turn in range(rounds + 1):
        gaps = ((points[:, None, :] - np.array(centroids)[None]) ** 2).sum(axis=2)
        cluster = gaps.argmin(axis=1)
        if turn < rounds:
            for c in set(cluster.tolist()):
                own = points[cluster == c]
                centroids[c] = [int(s) // len(own) for s in own.sum(axis=0)]
    distance = gaps.min(axis=1)
    sums = collections.Counter()
    for c, d in zip(cluster, distance):
        sums[int(c)] += int(d)
    return sorted(((k, int(c), int(d), sums[int(c)], int(distance.sum()), sha(",".join(map(str, centroids[c]))))
                   for (k, _), c, d in zip(kept, cluster, distance)), key=repr)


CLUSTERED = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
VECTOR = "vec_id long, embedding array<float>"


def vectors(seed, count, spread=0.05):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.4, (9, 64))
    return [(k, (middles[k % 9] + rng.normal(0, spread, 64)).astype(np.float32).tolist()) for k in range(count)]


def test_centroids_against_all_distances(spark):
    """A third of the rows is one vector; nulls, wrong lengths, non-finite ones, repeated and missing ids, many ties."""
    rows = vectors(1, 900)
    rows += [(10_000 + k, rows[7][1]) for k in range(450)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, rows[5][1])]
    rows += [(20_000, None), (20_001, []), (20_002, rows[0][1][:63]), (20_003, [None] + rows[0][1][1:]),
             (20_004, [float("nan")] + rows[0][1][1:]), (20_005, [float("-inf")] + rows[0][1][1:])]
    rows += [(30_000 + k, [0.0] * 64) for k in range(20)] + [(40_000, [-0.001] * 64), (40_001, [1000.0] * 64)]
    table = clashing(spark.createDataFrame(rows, VECTOR)).repartition(5)
    assert rows_of(centroid_clustering.clustered(table), *CLUSTERED) == plain_clusters(rows)


def test_centroids_of_few_rows(spark):
    rows = vectors(2, 12)
    table = spark.createDataFrame(rows, VECTOR)
    assert rows_of(centroid_clustering.clustered(table), *CLUSTERED) == plain_clusters(rows)
    assert centroid_clustering.clustered(table.limit(0)).count() == 0
    nameless = centroid_clustering.clustered(spark.createDataFrame([(None, rows[0][1])], VECTOR)).collect()
    assert [tuple(r) for r in nameless] == [(None,) * 6]


def test_bounds_spare_exact_distances():
    """Every centroid left out is farther; of separated clusters most are left out."""
    rng = np.random.default_rng(3)
    middles = rng.integers(-4000, 4000, (12, 16))
    points = np.repeat(middles, 50, axis=0) + rng.integers(-40, 40, (600, 16))
    pivots = centroid_clustering.farthest_first(middles, 6)
    assert len(np.unique(pivots, axis=0)) == 6
    cluster, distance, exact = centroid_clustering.nearest(
        points, centroid_clustering.pivot_distances(points, pivots), middles, pivots)
    gaps = ((points[:, None] - middles[None]) ** 2).sum(axis=2)
    assert (cluster == gaps.argmin(axis=1)).all() and (distance == gaps.min(axis=1)).all()
    assert exact < 0.2 * gaps.size


def test_bounds_hold_for_large_components():
    rng = np.random.default_rng(4)
    points = rng.integers(-centroid_clustering.LIMIT, centroid_clustering.LIMIT, (200, 64))
    points[100:] = points[0] + rng.integers(-2, 3, (100, 64))  # nearly equal, far from the origin
    middles = points[::20]
    pivots = centroid_clustering.farthest_first(middles, 4)
    cluster, distance, _ = centroid_clustering.nearest(
        points, centroid_clustering.pivot_distances(points, pivots), middles, pivots)
    gaps = ((points[:, None] - middles[None]) ** 2).sum(axis=2)
    assert (cluster == gaps.argmin(axis=1)).all() and (distance == gaps.min(axis=1)).all()


# URL filters

URLS = [
    (1, "https://Shop.Example.ORG/es/a?x=1", "example.org/es/", "block"),
    (2, "https://example.org/en/1234", "example.org/en/1", "block"),
    (3, "https://example.org/en/2", "org/", "allow"),
    (4, "https://notexample.org/es/", "org/", "allow"),
    (5, "https://a.com/fr/casino", "com/fr/", "allow"),
    (6, "https://a.com/de/", "com/de/", "block"),
    (7, "https://a.com/it/", None, "allow"),
    (8, "https://a.net/CASINO.html", None, "block"),
    (9, "https://a.net/casinos", None, "allow"),
    (10, "https://a.net/free/free/Free", None, "allow"),
    (11, "https://a.net/free-Sex", None, "block"),
    (12, "https://essex.net/free", None, "allow"),
    (13, "https://a.net/x%20casino%2f", None, "block"),
    (14, "example.org/es/", None, "allow"),
    (15, None, None, "allow"), (16, "", None, "allow"), (17, "https://example.org", None, "allow"),
    (18, "https://example.org#/es/", None, "allow"), (19, "a://b.org/x://c.com/de/", "org/", "allow"),
    (20, "https://a.net/" + "y/" * 200_000 + "porn", None, "block"),
    (21, "https://sexy.net/sexy", None, "allow"), (22, "https://ünïcode.net/éporn", None, "block"),
    (None, "https://example.org/es/", "example.org/es/", "block"), (1, "https://a.com/de/", "com/de/", "block"),
]


def test_url_rules_and_terms(spark):
    pages = clashing(spark.createDataFrame([(i, u, "html") for i, u, *_ in URLS], "page_id long, url string, html string"))
    found = url_filters.judge_urls(pages)
    assert rows_of(found, "page_id", "rule", "verdict") == sorted(((i, r, v) for i, _, r, v in URLS), key=repr)
    hosts = {r.page_id: (r.host, r.path) for r in found.collect()}
    assert hosts[18] == ("example.org", "") and hosts[19] == ("b.org", "/x://c.com/de/") and hosts[14] == ("", "")
    kept = url_filters.accepted_pages(pages)
    assert kept.columns == pages.columns and kept.count() == sum(v == "allow" for *_, v in URLS)
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_vocabulary_against_search_of_every_place():
    pick = random.Random(6)
    strict, soft = ["aba", "ab", "b"], ["a", "bab", "ab"]
    vocabulary = url_filters.Vocabulary(strict, soft)
    for _ in range(500):
        url = "".join(pick.choice("aAbB-./%2") for _ in range(pick.randrange(25)))
        text = url_filters._ESCAPE.sub(" ", url.lower())
        want = collections.Counter()
        for term in set(strict + soft):
            for k in range(len(text)):
                edges = text[k - 1:k] + text[k + len(term):k + len(term) + 1] if k else text[len(term):len(term) + 1]
                if text.startswith(term, k) and not any(c.isalnum() for c in edges):
                    want[term, "strict" if term in strict else "soft"] += 1
        assert collections.Counter(vocabulary.hits(url)) == want


def test_no_rules_and_no_terms(spark):
    pages = spark.createDataFrame([(1, "https://a.com/porn")], "page_id long, url string")
    assert [r.verdict for r in url_filters.judge_urls(pages, rules=(), strict=(), soft=()).collect()] == ["allow"]
    with pytest.raises(ValueError):
        url_filters.judge_urls(pages, several=0)


# The pipeline's stages on columns under any names

def test_stages_with_clashing_columns(spark, tmp_path):
    rows = [(k, f"text number {k} " + "word " * 30 + str(k % 3), "en", "s", 9) for k in range(12)] + [(None, None, None, None, None), (3, "", "en", "s", 0)]
    taken = ("__id", "__file", "__row", "rejected_id", "gone_id", "leak_id", "Kept_File", "kept_row", "id", "label")
    docs = spark.createDataFrame(rows, DOC).withColumns({name: F.lit(name) for name in taken})
    spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "another text of eight words or so here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == [f.split()[0] for f in DOC.split(", ")] + list(taken)
    assert docs.count() > 0
