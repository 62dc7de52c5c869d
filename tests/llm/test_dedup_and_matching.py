import functools
import hashlib
import random
from collections import Counter
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from patchloom.llm import common, decontaminate, quality_rules, simhash, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(11)
WORDS = [f"w{i}" for i in range(40)] + ["Émile", "straße", "#tag", "x*y", "A-B"]
PASSAGE = " ".join(random.choices(WORDS, k=60))


@functools.cache
def texts():
    out = [None, "", "   \n", "one two", "short line of words"]
    for i in range(30):
        words = random.choices(WORDS, k=random.randint(5, 160))
        if i % 3 == 0:
            words[3:3] = PASSAGE.split()
        out.append(" ".join(words) if i % 4 else "\n".join([" ".join(words[:9])] * 3 + [" ".join(words)]))
    out += [out[10], out[10], out[12].replace("w1", "w2", 1), PASSAGE + " tail " + PASSAGE, "Ünïcödé " * 15]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 0) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def alnum(text):
    return common.alnum_words((text or "").encode())


def test_alnum_words():
    assert common.alnum_words("Añb_C d1-É".encode()) == ["añb".encode(), b"c", b"d1", "É".encode()] and common.alnum_words(None) == []


def test_matches_equal_brute_force(spark, docs):
    items = [(1, PASSAGE), (2, "one two"), (10, "w1"), (3, None), (4, ""), (5, " ".join(PASSAGE.split()[20:50]) + " zz")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, text in enumerate(texts()):
        words, hit, names = alnum(text), set(), set()
        for item, body in items:
            own = alnum(body)
            n = min(13, len(own))
            windows = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)} if own else set()
            for p in range(len(words) - n + 1 if n else 0):
                if tuple(words[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    names.add(item)
        want[i] = (len(words), len(hit), names, bool(hit) and 20 * len(hit) >= len(words))
    for block in (1 << 20, 40):  # all items at once, and in several blocks
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], set(map(int, r["item_ids"])), r["contaminated"]) for r in decontaminate.decontaminate(docs, benchmark, block_bytes=block).collect()}
        assert got == want
        clash = docs.withColumns({"n_words": F.lit(1), "matches": F.lit(2), "contaminated": F.lit(True)})
        kept = decontaminate.remove_contaminated(clash, benchmark, block_bytes=block)
        assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if not w[3]}
    longest = [m for r in decontaminate.decontaminate(docs, benchmark).where("doc_id = 38").collect() for m in r["matches"] if m["item_id"] == "1"]
    assert {(m["doc_start"], m["item_start"], m["n_words"]) for m in longest} >= {(0, 0, len(alnum(PASSAGE)))}


def test_no_items_and_no_documents(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.decontaminate(docs, none).collect()} == {0}
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("block", [8 << 20, 200], ids=["one block", "several blocks"])
def test_decontamination_keeps_repeated_and_null_ids_apart(spark, block):
    passage = [" ".join(f"p{k}w{i}" for i in range(20)) for k in range(6)]
    own = " ".join(f"own{i}" for i in range(25))
    rows = [(1, f"{passage[0]} {own}"), (1, own), (1, f"{own} {passage[3]}"), (None, passage[5]), (None, own), (None, None), (2, passage[1]), (2, passage[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(passage)), "item_id long, text string")
    got = decontaminate.decontaminate(docs, benchmark, block_bytes=block).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    want = [(1, 45, 20, (0,)), (1, 25, 0, ()), (1, 45, 20, (3,)), (None, 20, 20, (5,)), (None, 25, 0, ()), (None, 0, 0, ()), (2, 20, 20, (1,)), (2, 20, 20, (1,))]
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(map(int, r["item_ids"]))) for r in got), key=key) == sorted(want, key=key)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    assert (len(list(decontaminate.item_blocks(benchmark, "item_id", "text", block))) > 1) == (block == 200)


@pytest.mark.parametrize("block", [8 << 20, 60], ids=["one block", "several blocks"])
def test_items_by_any_id_and_shared_passages(spark, block):
    header = " ".join(f"h{i}" for i in range(30))
    items = [("q10", header + " x1 x2"), ("q2", "y1 " + header), (None, " ".join(f"n{i}" for i in range(15))), (None, "z1 z2 z3"), ("q2", "w1 w2"), ("q3", None)]
    docs = spark.createDataFrame([("a", f"y1 {header} x1 x2"), ("b", " ".join(f"n{i}" for i in range(14)) + " z1 z2 z3 w1 w2"), (None, "nothing here")], "doc_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id string, text string"), block_bytes=block).collect()}
    assert (got["a"]["n_hit"], set(got["a"]["item_ids"])) == (33, {"q10", "q2"})
    assert (got["b"]["n_words"], got["b"]["n_hit"], set(got["b"]["item_ids"])) == (19, 19, {None, "q2"}) and got[None]["n_hit"] == 0
    if block > 60:
        assert [(m["item_id"], m["doc_start"], m["n_words"]) for m in got["a"]["matches"]] == [("q2", 0, 31), ("q10", 19, 14)]


def test_a_passage_of_many_items_is_one_match():
    header = b" ".join(b"h%d" % i for i in range(40))
    items = [(str(i), header + b" own%d a%d" % (i, i)) for i in range(1500)]
    index = decontaminate.Suffixes(items, 13)
    n_words, matches, names = index.measure([b"in " + header + b" out", b" ".join([header] * 150)])
    assert [(m["doc_start"], m["n_words"]) for m in matches[0]] == [(1, 40)] and len(names[0]) == 1500
    assert len(matches[1]) == 150 and n_words[1] == 6000


def test_quality_counts_equal_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for i, text in enumerate(texts()):
        raw = text or ""
        words = raw.split()
        wins = [tuple(words[p : p + 5]) for p in range(len(words) - 4)]
        cover = {q for p, w in enumerate(wins) if wins.count(w) > 1 for q in range(p, p + 5)}
        lines = [x for x in raw.split("\n") if x.strip()]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(raw.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(cover) > 20 * len(words)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_bad_hosts_take_their_documents(spark):
    good = " ".join(WORDS[:30])
    rows = [(i, good if i % 40 else "bad", "en", "fine", 0) for i in range(200)] + [(200 + i, "bad" if i % 10 else good, "en", "junk", 0) for i in range(100)] + [(300, "bad", "en", "tiny", 0), (301, good, "en", "tiny", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("mine"))
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    # junk goes with its good pages; the tiny host fails as often, but is drawn to the mean of all
    assert ids == {i for i in range(200) if i % 40} | {301}


def naive_fingerprint(text):
    raw = (text or "").encode().lower().split()
    if not raw:
        return 0
    n = min(4, len(raw))
    hashes = [xxhash.xxh64_intdigest(b" ".join(raw[p : p + n]), 42) for p in range(len(raw) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return [find(i) for i in range(len(prints))]


def test_near_duplicates_equal_brute_force(spark, docs):
    prints = [naive_fingerprint(t) for t in texts()]
    want = dict(enumerate(zip(prints, components(prints))))
    for limit in (8192, 3):  # with and without shards cut into chunks
        got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs, shard_limit=limit).collect()}
        assert got == want
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {c for _, c in want.values()}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a), (3, a), (5, b), (5, a), (None, b), (None, "c d e f g"), (None, "c d e f g"), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"fp": F.lit("x"), "uid": F.lit(1), "component": F.lit(2)})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in kept.collect()) == [(0, "c d e f g"), (3, a), (5, b), (8, "")]
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter({(3, 3): 2, (5, 5): 1, (5, 3): 1, (None, 5): 1, (None, None): 2, (9, 8): 1, (8, 8): 1})


def test_links_of_random_fingerprints(spark):
    draw = random.Random(5)
    base = [draw.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base:  # chains of small steps
        for _ in range(12):
            b ^= sum(1 << x for x in draw.sample(range(64), draw.randint(1, 6)))
            prints.add(b)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    for limit in (8192, 4):
        links = simhash.near_links(spark.createDataFrame(signed, "fp long"), limit)
        found = {r["node"]: r["component"] for r in simhash.connected_components(links).collect()}
        groups, naive = {}, {}
        for p, c in zip(prints, components(prints)):
            naive.setdefault(c, set()).add(p)
        for (p,) in signed:
            groups.setdefault(found.get(p, p), set()).add(p % (1 << 64))
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, naive.values()))


def naive_kept(all_texts, window):
    words = [(t or "").split() for t in all_texts]
    first = {}
    for i, w in enumerate(words):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    out = []
    for i, w in enumerate(words):
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        out.append([x for p, x in enumerate(w) if p not in gone])
    return out


def test_substring_dedup_equals_brute_force(spark, docs):
    want = naive_kept(texts(), 50)
    got = {r["doc_id"]: r for r in substring_dedup.dedup_digest(docs).collect()}
    for i, left in enumerate(want):
        n = len((texts()[i] or "").split())
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, n - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest())
    clash = docs.withColumns({"factors": F.lit(1), "anchors": F.lit("x"), "place": F.lit(2)})
    cleaned = substring_dedup.remove_duplicates(clash)
    assert cleaned.columns == clash.columns
    after = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert after[0] is None and all((after[i] or "").split() == left for i, left in enumerate(want))
    assert substring_dedup.dedup_digest(docs.limit(0)).count() == 0


def test_factors_name_the_earliest_reference(spark):
    a, b = " ".join(f"a{i}" for i in range(70)), " ".join(f"b{i}" for i in range(55))
    rows = spark.createDataFrame([(1, a), (2, b), (3, f"x {b} y {a} z"), (4, f"x {b} y"), (None, a), (5, a), (5, a)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(f) for f in r["factors"]] for r in substring_dedup.factors(rows).collect()}
    # document 4 stands whole in document 3, whose phrases have the earlier entries of 2 inside
    assert got == {3: [(1, 55, 2, 0), (57, 70, 1, 0)], 4: [(0, 57, 3, 0)], 5: [(0, 70, 1, 0)]}
    digest = substring_dedup.dedup_digest(rows).collect()
    assert len(digest) == 7 and sorted(r["n_removed"] for r in digest) == [0, 0, 0, 57, 70, 70, 125]


def test_factors_are_pieces_of_their_reference(spark):
    draw = random.Random(21)
    passages = [[f"p{k}_{i}" for i in range(draw.randint(12, 40))] for k in range(8)]
    all_texts = []
    for i in range(120):
        words = []
        for _ in range(draw.randint(1, 9)):
            words += draw.choice(passages) if draw.random() < 0.8 else [f"own{i}_{j}" for j in range(draw.randint(1, 8))]
        all_texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string").repartition(4)
    window, n, long = 20, 0, 0
    want = naive_kept(all_texts, window)
    for r in substring_dedup.factors(rows, window=window, anchor=5).collect():
        words = all_texts[r["doc_id"]].split()
        for f in r["factors"]:
            there = all_texts[f["reference"]].split()
            at, q, k = f["start"], f["reference_start"], f["n_words"]
            assert f["reference"] < r["doc_id"] and k >= window and words[at : at + k] == there[q : q + k]
            # the longest piece that stands there, but for references that hold the next phrase twice
            crossing = words[at + k - window + 1 : at + k + 1]
            twice = sum(there[x : x + window] == crossing for x in range(len(there))) > 1
            assert at + k == len(words) or q + k == len(there) or words[at + k] != there[q + k] or twice
            n += 1
            long += not twice
    assert n > 60 and long > 40
    got = {r["doc_id"]: r for r in substring_dedup.dedup_digest(rows, window=window, anchor=5).collect()}
    assert all(got[i]["kept_sha256"] == hashlib.sha256(" ".join(w).encode()).hexdigest() for i, w in enumerate(want))


def test_rows_of_one_id_lose_only_their_own_words(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (7, a + " t"), (7, b), (7, b), (8, b), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_digest(docs).collect())
    assert got == [(0, 60, 0), (3, 60, 0), (7, 60, 0), (7, 60, 0), (7, 61, 60), (8, 60, 60)]
    cleaned = sorted((r["doc_id"] or 0, r["text"]) for r in substring_dedup.remove_duplicates(docs).collect())
    assert cleaned == [(0, b), (3, a), (7, b), (7, b), (7, "t"), (8, "")]
