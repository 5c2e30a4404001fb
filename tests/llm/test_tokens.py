"""Token counts and packing against the libraries; decontamination against brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF_SMALL
from veilspark.llm import decontam, packing, token_counts
from veilspark.llm.common import read
from veilspark.llm.queries import QUERIES, pack_digest

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*" \n\t'stmdrevl''  aàñ1٣²½!?.,́漢字　😀ſİ\xa0\x85\x1c​#$ ", "<|endoftext|>", "<|startoftext|>", "'ve", "'re", " the", "ing", "'ll"]


def _texts(n, size):
    rnd = random.Random(5)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t) for i, t in enumerate(_texts(60, 80))]
    rows += [(100, None), (101, ""), (None, "one two"), (102, "long text " * 30_000), (103, "x" * 70_000), (104, "same"), (104, "same")]
    return spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, _tokens int, n string")


def test_counting_transducer_and_chunks():
    lib = Tokenizer.from_file(BYTES)
    with open(BYTES, encoding="utf-8") as f:
        machine = token_counts.CountingTransducer(f.read())
    for t in _texts(400, 60):
        want = len(lib.encode(t, add_special_tokens=False).ids)
        assert {machine.count(t, c) for c in (1 << 16, 1, 3, 8)} == {want}, t


def test_character_classes_are_the_librarys():
    split = Tokenizer.from_file(BYTES).pre_tokenizer.pre_tokenize_str
    for c in [*range(0xD800), *range(0xE000, 0x110000)][::7]:
        t = f"a{chr(c)}1"
        assert [p[1][0] for p in split(t)] == token_counts.token_starts(t).tolist(), hex(c)


def test_token_counts_edges(edges):
    lib = Tokenizer.from_file(BYTES)
    out = token_counts.count_tokens(edges, BYTES)
    assert out.columns == [*edges.columns, "n_tokens"]
    rows = out.collect()
    assert len(rows) == edges.count()
    for r in rows:
        assert r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids)
    assert token_counts.count_tokens(edges.limit(0), BYTES).count() == 0


def test_token_query(spark):
    lib = Tokenizer.from_file(BYTES)
    docs = {r.doc_id: r.text or "" for r in read(spark, SF_SMALL, "documents").collect()}
    for r in QUERIES["op5_token_counts"](spark, SF_SMALL).collect():
        t = docs.pop(r.doc_id)
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)
    assert not docs


def _check_packing(pieces, docs, key=lambda r: r.doc_id):
    lib = Tokenizer.from_file(WORDS)
    want = defaultdict(list)
    for d, t in docs:
        want[d].append([*lib.encode(t or "", add_special_tokens=False).ids, 1])
    sequences = defaultdict(list)
    total = defaultdict(int)
    for r in pieces:
        assert any(len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
                   for ids in want[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
        total[r.doc_id, r.start] += 1
    assert sum(r.length for r in pieces) == sum(len(i) for v in want.values() for i in v)
    for d, v in want.items():  # as many first pieces as rows
        assert total[d, 0] == len(v)
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0  # all of them full or at a power of two


def test_packing_round_trip(spark, edges):
    _check_packing(QUERIES["op8_packing"](spark, SF_SMALL).collect(), [(r.doc_id, r.text) for r in read(spark, SF_SMALL, "documents").collect()])
    many = packing.pack(edges, WORDS, end_id=1, task_tokens=20_000)
    _check_packing(pack_digest(many).collect(), [(r.doc_id, r.text) for r in edges.collect()])
    assert packing.pack(edges.limit(0), WORDS, end_id=1).count() == 0


def test_hilbert_curve_visits_each_cell_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_like_documents_lie_together():
    with open(WORDS, encoding="utf-8") as f:
        ids = packing.Ids(f.read())
    texts = ["red green blue " * 20 + f"x{i}" for i in range(20)] + ["seven eight nine ten " * 20 + f"y{i}" for i in range(20)]
    order = np.argsort(packing.curve_keys([np.frombuffer(ids.of(t), ids.type) for t in texts]), kind="stable")
    assert ((order < 20)[1:] != (order < 20)[:-1]).sum() == 1


ITEM = "The train leaves Boston at 9 am and travels 60 miles per hour to reach Albany in 3 hours, said Ms Smith of Salem."


def _found(text, items=((1, ITEM),), **kw):
    return [i for i, *_ in decontam.Items(list(items), kw.get("similarity", 0.8)).search(*decontam.Reader().template(text))]


def test_templates_and_slots():
    assert _found(f"before that. {ITEM} And after.") == [1]
    assert _found(ITEM.lower().replace(",", "")) == [1]
    moved = ITEM.replace("Boston", "Lyon").replace("9", "11").replace("60", "75").replace("miles", "km").replace("Albany", "Dijon").replace("3", "2")
    assert _found(moved) == [1]
    # one slot with two values is another question
    twice = "The price of 5 pens and 5 more pens is higher than the price of 5 books today in town"
    assert _found(twice.replace("5", "7"), [(2, twice)]) == [2]
    assert _found("The price of 7 pens and 8 more pens is higher than the price of 9 books today in town", [(2, twice)]) == []
    assert _found("leaves Boston at 9 am and then something else is told of it") == []
    assert _found("a train travels", [(3, "train travels")]) == [3]
    assert _found("9 9 9 9 9 9 9 9 9", [(4, "1 2 3 4 5 6 7 8")]) == []


def test_names_that_open_sentences_and_names_of_several_words():
    eggs = "Janet has 16 eggs. Janet eats 3 eggs each morning. Janet sells 9 eggs to Tom."
    other = "Maria has 20 eggs. Maria eats 4 eggs each morning. Maria sells 7 eggs to Paul."
    assert _found(other, [(5, eggs)]) == [5]
    assert _found(f"so he said:\n{other}\nThen more.", [(5, eggs)]) == [5]
    assert _found(eggs.lower(), [(5, eggs)]) == [5]
    assert _found(other.replace("Maria sells", "Anna sells").replace("Maria eats", "Paul eats"), [(5, eggs)]) == []
    # the name opens a sentence in one text only
    assert _found(f"it is said that {other}", [(5, eggs)]) == [5]
    trip = "A bus from New York to Boston takes 4 hours and a seat costs 30 dollars."
    for a, b in (("Paris", "Lyon"), ("Paris", "Le Havre"), ("San Luis Obispo", "Lyon")):
        assert _found(trip.replace("New York", a).replace("Boston", b).replace("30", "45"), [(6, trip)]) == [6]
        assert _found(trip, [(6, trip.replace("New York", a).replace("Boston", b))]) == [6]
    pens = "Mary Ann Smith buys 5 red pens and 3 blue books in the shop."
    assert _found(pens.replace("Mary Ann Smith", "Tom").replace("5", "8"), [(7, pens)]) == [7]
    assert _found(pens.replace("Mary Ann Smith", "Tom Jones").replace("5", "8"), [(7, pens)]) == [7]
    # other words at the opening of sentences do not hide a copy
    long = "The a b c d e f g. The h i j k l m n o p q r."
    assert _found(long.replace("The a", "An a"), [(8, long)]) == [8]


def test_decontamination_query_equals_brute_force(spark):
    docs = read(spark, SF_SMALL, "documents").collect()
    bench = read(spark, SF_SMALL, "benchmark").collect()
    words = lambda t: " " + " ".join(w for w in "".join(c.lower() if c.isalnum() else " " for c in t).split()) + " "
    items = {b.item_id: words(b.text) for b in bench}
    want = {(d.doc_id, i) for d in docs for i, t in items.items() if t in words(d.text or "")}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_decontamination"](spark, SF_SMALL).collect()}
    assert want and got == want


def test_decontamination_edges(spark):
    docs = spark.createDataFrame([(1, ITEM, 0, 0), (1, ITEM, 0, 0), (2, None, 0, 0), (3, "", 0, 0), (None, ITEM, 0, 0), (4, "x " * 200_000 + ITEM, 0, 0)],
                                 "doc_id long, text string, item_id int, _leaks int")
    bench = spark.createDataFrame([(7, ITEM), (8, ITEM), (9, None), (10, ""), (None, ITEM), (11, "…")], "item_id long, text string")
    out = decontam.find_leaks(docs, bench)
    assert out.columns == [*docs.columns, "leaks"]
    got = sorted((str(r.doc_id), [x.item_id for x in r.leaks]) for r in out.collect())
    assert got == [("1", [7, 8]), ("1", [7, 8]), ("2", []), ("3", []), ("4", [7, 8]), ("None", [7, 8])]
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0
    assert {len(r.leaks) for r in decontam.find_leaks(docs, bench.limit(0)).collect()} == {0}


def test_capitals_and_number_words():
    firm = "IBM sold 20 units to NASA in the spring and kept 5 units for eBay until the end of the term."
    other = firm.replace("IBM", "GE").replace("NASA", "the ESA").replace("the ESA", "ESA").replace("eBay", "McDonald").replace("20", "35").replace(" 5 ", " 8 ")
    assert _found(other, [(1, firm)]) == [1]
    eggs = "Her hens lay 16 eggs a day and she sells the remaining eggs at the market for 2 dollars each."
    assert _found(eggs.replace("16", "sixteen").replace("2 dollars", "three euros"), [(2, eggs)]) == [2]
    assert _found(eggs.replace("16", "twenty-five"), [(2, eggs)]) == [2]
    assert _found("Her cat sleeps a day and she sells old books at the fair for a few dollars each.", [(2, eggs)]) == []


def _questions(rnd, n):
    """Questions with slots for names, numbers and units, each of its own words."""
    words = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 3))) for _ in range(900)]
    for i in range(n):
        yield [rnd.choice(words) if rnd.random() < 0.72 else rnd.choice(("{name}", "{number}", "{number} {unit}", "{org}", "{word}")) for _ in range(rnd.randint(15, 30))]


def _filled(rnd, parts):
    name = lambda: rnd.choice(("Anna", "Paul", "Maria Lopez", "New York", "Lyon", "Tom", "Dr Smith"))
    out = []
    for k, p in enumerate(parts):
        out.append(p.format(name=name(), number=rnd.randint(2, 9999) * 10 + k, unit=rnd.choice(("km", "hours", "dollars", "kg")),
                            org=rnd.choice(("IBM", "NASA", "ESA", "eBay")), word=rnd.choice(("sixteen", "forty", "seven", "twelve"))))
    return " ".join(out) + "."


def test_planted_questions_are_found(spark):
    """Recall over re-parameterised questions, precision over texts of the same words."""
    rnd = random.Random(31)
    questions = list(_questions(rnd, 200))
    items = [(i, _filled(rnd, q)) for i, q in enumerate(questions)]
    docs, want = [], set()
    for i, q in enumerate(questions):
        plain = list(_questions(rnd, 1))[0]
        docs.append((i, " ".join(plain[:8]).replace("{", "").replace("}", "") + ". " + _filled(rnd, q) + " " + " ".join(plain[8:]).replace("{", "").replace("}", "")))
        want.add((i, i))
        docs.append((1000 + i, _filled(rnd, plain)))
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, x.item_id) for r in found.collect() for x in r.leaks}
    assert not {g for g in got if g[0] >= 1000}
    recall = len(got & want) / len(want)
    assert recall >= 0.9 and got <= want, (recall, len(got - want))
    # a Spark join and a walk over all pairs say the same
    brute = decontam.Items(items, 0.8)
    assert got == {(d, i) for d, t in docs for i, *_ in brute.search(*decontam.Reader().template(t))}


def test_one_opening_of_many_items_and_many_copies(spark):
    """A window that all items share, and one text that a third of the documents are."""
    rnd = random.Random(8)
    opening = "in the following passage choose the best answer to this"
    items = [(i, opening + " " + " ".join(f"w{rnd.randint(0, 5000)}x" for _ in range(12))) for i in range(400)]
    docs = [(i, f"noise here {opening} w1x and so on {i}") for i in range(300)] + [(1000 + i, items[7][1]) for i in range(150)]
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in found.collect()}
    brute = decontam.Items(items, 0.8)
    want = {t: [i for i, *_ in brute.search(*decontam.Reader().template(t))] for t in {t for _, t in docs}}
    assert got == {d: want[t] for d, t in docs} and want[items[7][1]] == [7]


def test_merging_looks_up_only_pairs_that_changed():
    with open(BYTES, encoding="utf-8") as f:
        machine = token_counts.CountingTransducer(f.read())
    merge = machine.merge

    class Ranks(dict):
        asked = 0

        def get(self, *a):
            Ranks.asked += 1
            return super().get(*a)

    ranks = machine.ranks
    machine.ranks = Ranks(ranks)
    rng = random.Random(5)
    for word in [b"", b"a", *(bytes(rng.choice(b"the rain \xc3\xa9019xz") for _ in range(rng.randint(2, 300))) for _ in range(60))]:
        Ranks.asked = 0
        parts = merge(word)
        assert Ranks.asked <= 3 * len(word)
        # plain statement: the least rank, leftmost first, of all pairs each time
        plain = [word[i:i + 1] for i in range(len(word))]
        while pairs := [(ranks[p], i) for i, p in enumerate(zip(plain, plain[1:], strict=False)) if p in ranks]:
            i = min(pairs)[1]
            plain[i:i + 2] = [plain[i] + plain[i + 1]]
        assert parts == plain
        # an edge is given up as soon as a pair is merged across it, and only then
        ends = {sum(map(len, plain[:k])) for k in range(len(plain) + 1)}
        for edge in range(1, len(word)):
            assert (merge(word, edge) is None) == (edge not in ends)
