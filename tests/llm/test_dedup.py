"""Sharding, line dedup, SimHash and quality rules: brute force, edges, skew."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from veilspark.llm import line_dedup, rules, sharding, simhash
from veilspark.llm.common import Scratch, read
from veilspark.llm.graph import components
from veilspark.llm.queries import QUERIES


# ------------------------------------------------------------------ sharding
def _prefix(doc_id, depth):
    h = int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)
    return f"{h:060b}"[:depth] or "-"


def _check_shards(rows, limit):
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.n_bytes
    for r in rows:
        assert sizes[r.shard] <= limit or r.oversized and sizes[r.shard] == r.n_bytes
        assert r.shard.split("/")[0] == _prefix(r.doc_id, r.local_depth)
    return sizes


def test_shards_fit_and_split_only_where_needed(spark):
    rows = [(i, "x" * (i % 50)) for i in range(400)] + [(900, None), (901, ""), (None, "null key"), (902, "y" * 5000)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, shard int, _key int")
    got = sharding.assign_shards(docs, 1000).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    _check_shards(got, 1000)
    for r in got:  # the parent bucket was too large
        if r.local_depth:
            parent = [b for i, b in ((i, len(t or "")) for i, t in rows) if _prefix(i, r.local_depth - 1) == _prefix(r.doc_id, r.local_depth - 1)]
            assert sum(parent) > 1000 and len(parent) > 1
    assert sharding.assign_shards(docs.limit(0), 1000).count() == 0
    whole = sharding.assign_shards(docs, 1 << 30).collect()
    assert {r.shard for r in whole} == {"-"}


def test_one_key_with_many_rows_gets_pages(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.repeat(F.lit("z"), 40).alias("text"))
    got = sharding.assign_shards(docs, 2000).collect()
    assert len(got) == 3000
    sizes = _check_shards(got, 2000)
    assert sum("/" in s for s in sizes) >= 1000 * 40 / 2000


def test_written_shards_hold_each_row_once(spark, tmp_path):
    docs = spark.range(1500).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.floor(F.col("id") / 2)).alias("doc_id"),
                                    F.when(F.col("id") % 50 != 1, F.repeat(F.lit("z"), 40)).alias("text"), (F.floor(F.col("id") / 2)).alias("n"))
    docs = docs.unionByName(spark.createDataFrame([(None, "null key", 1), (None, "null key", 1), (7, "y" * 5000, 1)], docs.schema))
    for frame, folder in ((docs, "shard"), (docs.withColumn("shard", F.lit(1)).withColumn("_row", F.lit(2)), "_shard")):
        path = str(tmp_path / folder)
        sharding.write_shards(frame, path, 2000)
        got = spark.read.parquet(path)
        assert Counter(got.select(*frame.columns).collect()) == Counter(frame.collect())
        sizes = got.groupBy(folder).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"), F.count("*").alias("n")).collect()
        assert all(r["bytes"] <= 2000 or r["n"] == 1 for r in sizes) and len(sizes) > 500 * 40 / 2000


# ---------------------------------------------------------------- line dedup
def _brute_lines(docs, min_words):
    """Delete what lies in a run of min_words words that occurs earlier."""
    seqs = [(i, t.split("\n")) for i, t in sorted({(i, t) for i, t in docs if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]
    first, gone = {}, defaultdict(set)
    for i, lines in seqs:
        count = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(count[a:b]) >= min_words:
                    run = tuple(lines[a:b])
                    if run in first and first[run] != (i, a):
                        gone[i, "\n".join(lines)].update(range(a, b))
                    first.setdefault(run, (i, a))
    return {(i, "\n".join(lines)): "\n".join(x for k, x in enumerate(lines) if k not in gone[i, "\n".join(lines)]) for i, lines in seqs}


def test_line_runs_equal_brute_force(spark):
    rnd = random.Random(4)
    pool = ["a b", "c", "", "d e f g", "h i j", "  ", "k l m n o p", "q"]
    docs = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.9 else f"own {i} {k}" for k in range(rnd.randint(0, 14)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, docs[3][1]), (63, docs[3][1]), (64, "x y z\n" * 200)]
    df = spark.createDataFrame([(*d, 0, 0, 0) for d in docs], "doc_id long, text string, runs int, _th int, line int")
    for min_words in (1, 4, 9):
        out = line_dedup.dedup_lines(df, min_words=min_words)
        assert out.columns == [*df.columns, "n_lines", "n_removed"]
        want = _brute_lines(docs, min_words)
        rows = out.collect()
        assert len(rows) == len(docs)
        texts = dict(docs)
        for r in rows:
            t = texts[r.doc_id]
            assert r.text == (None if t is None else want[r.doc_id, t]), (min_words, r.doc_id)
            assert r.n_lines == (0 if t is None else t.count("\n") + 1)


def test_line_dedup_edges(spark):
    long = "\n".join(f"line number {i} of a rather long text" for i in range(3000))
    rows = [(1, long), (2, long), (2, long), (None, long), (3, "short\nshort"), (3, "short\nshort")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, len(r.text), r.n_removed) for r in line_dedup.dedup_lines(df).collect())
    # null sorts first and keeps its text; equal rows are one document
    assert got == Counter({(None, len(long), 0): 1, (1, 0, 3000): 1, (2, 0, 3000): 2, (3, 5, 1): 2})
    got = Counter((r.doc_id, len(r.text), r.n_removed) for r in line_dedup.dedup_lines(df, min_words=5).collect())
    assert got[3, 11, 0] == 2
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_repeated_short_lines_go(spark):
    """A repeated line of some words goes by itself, whatever stands around it."""
    licence = "Printed with the kind permission of all authors"
    rows = [(i, f"own words {i} a\n{licence}\nown words {i} b\nBest wishes") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, min_words=5).collect()}
    assert got == {i: t if i == 0 else t.replace(f"\n{licence}", "") for i, t in rows}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {i: t if i == 0 else t.replace(f"\n{licence}", "").replace("\nBest wishes", "") for i, t in rows}


# ------------------------------------------------------------------- simhash
def _print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _roots(links, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {n: top(n) for n in nodes}


def test_fingerprints():
    for t in (None, "", " \n", "one", "One TWO", "ÀB c\x1cd e", "a " * 400, "w\x0bx\x0cy z", "naïve Ünïcode wörds hêre nöw"):
        assert simhash.fingerprint_of(t) == _print(t)


def test_components_of_links_within_two_bits(spark):
    rnd = random.Random(9)
    prints = {0}
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(12):  # chains of near fingerprints
            prints.add(x)
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << b
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = sorted(signed(x) for x in prints)
    df = spark.createDataFrame([(x,) for x in nodes], "fp long")
    scratch = Scratch(spark, "test")
    got = {r.node: r.root for r in components(simhash.fingerprint_links(df), scratch).collect()}
    links = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    want = _roots(links, nodes)
    assert {n: got.get(n, n) for n in nodes} == want


def test_links_of_any_distance_and_segments(spark):
    rnd = random.Random(17)
    base = [rnd.getrandbits(64) for _ in range(12)]
    nodes = {b for b in base}
    for b in base:
        for _ in range(25):
            nodes.add(b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 6))))
    low = rnd.getrandbits(32)
    nodes |= {(rnd.getrandbits(32) << 32) | low for _ in range(300)}  # one segment value that many share
    nodes = sorted(n - (1 << 64) if n >> 63 else n for n in nodes)
    df = spark.createDataFrame([(n,) for n in nodes], "fp long")
    for bits, segments in ((0, 2), (1, 1), (2, 2), (3, 2), (3, 4), (5, 3), (2, 5)):
        got = {(r.a, r.b) for r in simhash.fingerprint_links(df, bits, segments).collect()}
        assert got == {(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits}, (bits, segments)


def test_component_shapes(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(200)]
    odd = [(5000, 5000), (6000, 6001), (6001, 6000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star + odd, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == _roots([x for x in chain + star + odd if x[0] != x[1]], {n for x in chain + star + odd if x[0] != x[1] for n in x})
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_simhash_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in read(spark, SF_SMALL, "documents").collect()}
    fp = {i: _print(t) for i, t in docs.items()}
    ids = sorted(docs)
    want = _roots([(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fp[a] ^ fp[b]).bit_count() <= 2], ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash"](spark, SF_SMALL).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in ids}


def test_near_dedup_edges(spark):
    a, b = "some words that make up a text of their own", "quite another one with none of these in it"
    rows = [(5, a), (3, a), (3, a), (None, b), (None, b), (8, None), (7, ""), (9, "word " * 100_000), (10, b + " x")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, _keep_id int, _keep_hash int")
    out = simhash.near_dedup(df)
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(3, a), (None, b), (7, ""), (9, rows[7][1]), (10, b + " x")])
    assert simhash.near_dedup(df.limit(0)).count() == 0
    assert {(r.doc_id, r.component_id) for r in simhash.groups(df).collect()} == {(5, 3), (3, 3), (None, None), (8, 7), (7, 7), (9, 9), (10, 10)}


# ------------------------------------------------------------- quality rules
def _counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_and_rules(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 25))) for _ in range(60)]
    texts += [None, "", "\n \n\t", "a#b *c|<>\x0bd\x1ce", "one two three four five\n" * 3, "é😀 ü\n\né😀 ü", "w " * 20_000, "A B C D E A B C D E A"]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 5 else None, 1) for i, t in enumerate(texts)] + [(4, texts[4], "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = rules.apply_rules(df).collect()
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, dup, rep = _counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), texts[r.doc_id]
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)
    assert rules.apply_rules(df.limit(0)).count() == 0


def test_fences_follow_their_group(spark):
    clean = [(i, " ".join(f"word{i}x{k}" for k in range(30)), "en", "a") for i in range(150)]
    marked = [(1000 + i, " ".join(f"w{i}{k} | #" for k in range(30)), "en", "b") for i in range(150)]  # a source full of marks
    odd = [(5000, " ".join(f"w{k} | #" for k in range(30)), "en", "a"), (5001, clean[0][1] + " y", "en", "rare")]
    df = spark.createDataFrame(clean + marked + odd, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in rules.apply_rules(df).collect()}
    assert not kept[5000] and kept[5001] and all(kept[i] for i, *_ in clean + marked)


def test_buckets_round_trip(spark):
    v = spark.range(0, 40_000).select(F.col("id").alias("v")).withColumn("b", F.expr(f"cast({rules._bucket('v')} as long)")) \
        .withColumn("top", F.expr(rules._bucket_top("b")))
    x = v.agg(F.min(F.col("top") - F.col("v")), F.max((F.col("top") - F.col("v")) / (F.col("v") + 1)), F.countDistinct("b"), F.countDistinct("top")).first()
    assert x[0] >= 0 and x[1] <= 1 / 16 and x[2] == x[3]


def test_clean_labelled_documents_stay(spark):
    got = QUERIES["op6_quality_rules"](spark, SF_CHECK).join(read(spark, SF_CHECK, "labels"), "doc_id")
    rate = {r.quality: r.k for r in got.where("n_words >= 10").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1] > 0.97 and rate[0] < 0.3
