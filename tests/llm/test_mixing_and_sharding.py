import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from patchloom.llm import mixing, quality_rules, sharding
from test_dedup_and_matching import components, naive_fingerprint

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    draw = random.Random(2)
    out = [(i, " ".join(["word"] * draw.randint(0, 400)) + f" d{i}", "en", f"s{draw.choice([0, 0, 0, 0, 1, 2, 3])}", 0) for i in range(150)]
    return out + [(150, None, "en", "s1", 0), (151, "", "en", None, 0), (152, "x " * 500, "en", None, 0), (153, "tiny", "en", "s9", 0), (154, " \n\t ", None, "s2", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def test_van_der_corput(spark):
    got = [r[0] for r in spark.range(6).select(mixing.van_der_corput(F.col("id"))).collect()]
    assert got == [0, 0.5, 0.25, 0.75, 0.125, 0.625]


def naive_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(target.values())
        open_ = [s for s in order if s not in target]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}


def test_mix_meets_targets(docs):
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    sizes = defaultdict(int)
    for i, text, _, source, _ in rows():
        n = len((text or "").split())
        sizes[source] += n
        assert got[i]["size"] == n
    want, taken = naive_targets(sizes), Counter()
    for i, _, _, source, _ in rows():
        assert got[i]["source_size"] == sizes[source] and abs(got[i]["target"] - want[source]) < 1e-6 and 0 <= got[i]["taken"] <= 3 * got[i]["size"]
        taken[source] += got[i]["taken"]
    for source, target in want.items():
        assert taken[source] == round(target), "each source meets its target to the word"
    assert got == {r["doc_id"]: r for r in mixing.mix(docs.repartition(5)).collect()}, "reruns agree"


@pytest.mark.parametrize("cells", [1024, 4])
def test_every_run_of_slots_has_the_weights(spark, docs, cells, monkeypatch):
    monkeypatch.setattr(mixing, "CELLS", cells)
    rows = mixing.sized_rows(docs, "doc_id", "source", "text", F.monotonically_increasing_id())
    placed, sources = mixing.placed_documents(rows)
    quota = {r["source_no"]: r["quota"] for r in sources.collect()}
    blocks = {s: -(-q // 16) for s, q in quota.items() if q}
    slots = sorted((r["slot"], r["source_no"], r["rank"]) for r in mixing.slots(spark, sources, 16).collect())
    n = sum(blocks.values())
    assert len(slots) == n and len({s for s, *_ in slots}) == n and slots[-1][0] < 8 * n
    for m in (64, 200, n):
        seen = Counter(s for slot, s, _ in slots if slot < m)
        assert all(abs(seen[s] - m * b / n) < 8 for s, b in blocks.items())
    # the points themselves name each slot's source
    ends = [sum(blocks[s] for s in sorted(blocks) if s <= x) for x in sorted(blocks)]
    for slot, source, _ in slots:
        u = sum((slot >> i & 1) / 2 ** (i + 1) for i in range(40)) * n
        assert sorted(blocks)[next(i for i, e in enumerate(ends) if u < e)] == source
    ranks = defaultdict(list)
    for _, source, rank in slots:
        ranks[source].append(rank)
    assert all(ranks[s] == list(range(-(-q // 16))) for s, q in quota.items())


def test_the_points_decide_where_documents_are(spark, docs, monkeypatch):
    mixed = mixing.mix(docs).collect()
    begins = {r["doc_id"]: r["first_slot"] for r in mixed if r["first_slot"] is not None}
    assert set(begins) == {r["doc_id"] for r in mixed if r["taken"]}
    seen = list(dict.fromkeys(r["doc_id"] for r in mixing.take_mix(docs).collect()))
    assert [begins[i] for i in seen] == sorted(begins.values()), "rows come in the order of slots"
    monkeypatch.setattr(mixing, "van_der_corput", lambda n: n / (8 * F.lit(60)))
    other = mixing.mix(docs).collect()
    assert {r["doc_id"]: r["first_slot"] for r in other if r["first_slot"] is not None} != begins


def test_take_mix_keeps_columns_and_repeats(spark, docs):
    clash = docs.withColumns({"size": F.lit(1), "taken": F.lit(2), "slot": F.lit(3), "uid": F.lit(4)})
    mixed = mixing.take_mix(clash)
    assert mixed.columns == clash.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) == {i for i, t in taken.items() if t} and max(copies.values()) <= 3
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.take_mix(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_have_places_of_their_own(spark):
    rows = [(None, f"w {i} " * (i + 1), "a") for i in range(30)] + [(7, "same text here", "a")] * 40 + [(7, "other " * 50, "b"), (8, "tiny", "c"), (9, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in got:
        name = {r["source_size"]: r["target"]}
        target |= name
        taken[r["source_size"]] += r["taken"]
    assert len(got) == len(rows) and all(taken[s] == round(t) for s, t in target.items()) and len(target) == 3
    kept = Counter((r["doc_id"], r["text"]) for r in mixing.take_mix(docs).collect())
    want = Counter()
    for r in got:
        want[r["doc_id"], r["size"]] += -(-r["taken"] // r["size"]) if r["size"] else 0
    found = Counter()
    for (i, text), n in kept.items():
        found[i, len(text.split())] += n
    # a row comes once for every epoch that takes a part of it
    assert all(want[k] <= found[k] <= want[k] + 1 for k in want) and set(found) <= set(want)


def test_shards_are_even_and_keep_groups(spark):
    draw = random.Random(8)
    texts = [f"text {draw.randint(0, 60)}" if i % 3 else f"own {i}" for i in range(500)] + ["hot"] * 250 + [None, None, "", ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(3).withColumns({"shard": F.lit(9), "key": F.lit("k")})
    out = sharding.shard_documents(docs, shards=8)
    got = out.collect()
    assert len(got) == len(texts) and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(counts[shard]))
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
    spread = defaultdict(set)
    for r in got:
        spread[texts[r["doc_id"]]].add(r["shard"])
    cut = [t for t, s in spread.items() if t is not None and len(s) > 1]
    assert cut == ["hot"], "only the group larger than a shard is parted"
    few = sharding.shard_documents(docs.limit(3), shards=8)
    assert few.count() == 3 and sharding.shard_documents(docs.limit(0)).count() == 0
    same = sharding.shard_documents(spark.createDataFrame([(1, "x", "en", "s", 0)] * 20, DOCS), shards=4).collect()
    assert sorted(Counter(r["shard"] for r in same).values()) == [5, 5, 5, 5]


@pytest.mark.parametrize("sizes", [[50] * 10, [700], [2] * 400, [60] * 30 + [2] * 90, [130] * 15, [2] * 1000], ids=["ten", "third", "pairs", "crowded", "above a shard", "all in pairs"])
def test_groups_are_cut_only_at_borders_or_above_a_shard(spark, sizes):
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)]
    texts += [f"own {i}" for i in range(2000 - len(texts))]
    random.Random(3).shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = sharding.shard_documents(docs, shards=20).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(2000))
    assert len({(r["shard"], r["slot"]) for r in got}) == 2000 and set(Counter(r["shard"] for r in got).values()) == {100}
    spread = defaultdict(set)
    for r in got:
        spread[texts[r["doc_id"]]].add(r["shard"])
    if max(sizes) == 50 or max(sizes) == 2:
        assert all(len(s) == 1 for s in spread.values()), "groups that fit are whole"
    for g, n in enumerate(sizes):
        parts = spread[f"group {g}"]
        assert len(parts) <= -(-n // 100) + (sizes != [700]) and max(parts) - min(parts) == len(parts) - 1
    assert sum(len(spread[f"group {g}"]) - 1 for g in range(len(sizes))) <= 19


def test_labels_equal_a_plain_propagation(spark, monkeypatch):
    """Where every label has room, each group ends at the label that most of its members begin with; the draw decides ties."""
    draw = random.Random(5)
    votes = {k: Counter(draw.choices(range(6), k=draw.randint(2, 9))) for k in range(80)}
    rows = [(k, sum(v.values()), [(n, draw.randrange(1000), b) for b, n in v.items()]) for k, v in votes.items()]
    groups = spark.createDataFrame(rows, "key long, members long, votes array<struct<n:long,draw:long,label:int>>")
    labels, held = sharding.propagate(groups, [1000 * b for b in range(7)])
    got = {r["key"]: r["label"] for r in labels.collect()}
    assert set(got) == set(votes) and all(votes[k][b] == max(votes[k].values()) for k, b in got.items())
    assert held == [sum(sum(votes[k].values()) for k, x in got.items() if x == b) for b in range(6)]
    # with tight quotas no shard gets more than its room, and hardly a group is left over
    tight, held = sharding.propagate(groups, [-(-b * 480 // 6) for b in range(7)])
    total = sum(sum(v.values()) for v in votes.values())
    assert tight.count() == 80 and sum(held) == total and max(held) <= 80 + 9


def test_pipeline_on_planted_cases(spark, tmp_path):
    draw = random.Random(4)
    vocabulary = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(draw.choices(vocabulary, k=n))
    clean = [(i, text(draw.randint(60, 200)), "en", f"s{i % 3}", 0) for i in range(60)]
    passage = text(40)
    planted = [(100, "same words " * 40, "en", "s0", 0), (101, clean[3][1], "en", "s1", 0), (102, passage + " " + text(30), "en", "s2", 0), (103, None, "en", "s2", 0), (104, "few words", "en", None, 0)]
    spark.createDataFrame(clean + planted, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in docs.collect()} == {i for i, *_ in clean}
    manifest = corpus_pipeline.run(spark, str(tmp_path)).collect()
    counts = Counter(r["shard"] for r in manifest)
    assert {r["doc_id"] for r in manifest} <= {i for i, *_ in clean} and max(counts.values()) - min(counts[s] for s in range(40)) <= 1


def words_of(text):
    return (text or "").split()


def brute_pipeline(docs, items):
    """Rows that come out, with repeats, by the plainest computation of each stage."""
    # rules: own counts, then hosts
    failed = []
    for _, text, _, _, _ in docs:
        words = words_of(text)
        grams = [tuple(words[p : p + 5]) for p in range(len(words) - 4)]
        seen = Counter(grams)
        cover = {q for p, g in enumerate(grams) if seen[g] > 1 for q in range(p, p + 5)}
        failed.append(len(words) < 10 or 100 * len(cover) > 20 * len(words))
    hosts = defaultdict(lambda: [0, 0])
    for (_, _, _, host, _), bad in zip(docs, failed):
        hosts[host][0] += 1
        hosts[host][1] += bad
    alpha, beta = quality_rules.prior(len(docs), sum(failed), len(hosts), float(sum(n * n for n, _ in hosts.values())), sum(f * f / n for n, f in hosts.values()))
    docs = [d for d, bad in zip(docs, failed) if not bad and (hosts[d[3]][1] + alpha) / (hosts[d[3]][0] + alpha + beta) <= 0.5]
    # one of each group of near fingerprints
    group = components([naive_fingerprint(d[1]) for d in docs])
    first = {}
    for i, g in enumerate(group):
        if g not in first or (docs[i][0] is None, docs[i][0] or 0) < (docs[first[g]][0] is None, docs[first[g]][0] or 0):
            first[g] = i
    docs = [docs[i] for i in sorted(first.values())]
    # benchmark passages
    windows = {tuple(w[p : p + 13]) for w in map(words_of, items) for p in range(len(w) - 12)}
    clean = []
    for d in docs:
        w = words_of(d[1])
        hit = {q for p in range(len(w) - 12) if tuple(w[p : p + 13]) in windows for q in range(p, p + 13)}
        if not hit or 20 * len(hit) < len(w):
            clean.append(d)
    # epochs of each row by its source's target
    sizes = defaultdict(int)
    for d in clean:
        sizes[d[3]] += len(words_of(d[1]))
    out, at = Counter(), defaultdict(int)
    target = naive_targets(sizes)
    for d in sorted(clean, key=lambda d: (hashlib.md5(str(d[0]).encode()).hexdigest()[:15], len(words_of(d[1])))):
        out[d[0], len(d[1].encode()) + 16, d[3]] += sum(e * sizes[d[3]] + at[d[3]] < round(target[d[3]]) for e in range(3))
        at[d[3]] += len(words_of(d[1]))
    return +out


def test_pipeline_equals_brute_force(spark, tmp_path):
    draw = random.Random(14)
    vocabulary = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(draw.choices(vocabulary, k=n))
    docs = [(i, text(draw.randint(5, 150)), "en", f"s{i % 5}", 0) for i in range(160)]
    passages = [text(40) for _ in range(3)]
    for i in range(0, 60, 4):
        docs.append((200 + i, docs[i][1] if i % 8 else docs[i][1] + " end", "en", f"s{i % 3}", 0))  # copies, and texts with a word more
    docs += [(300 + i, text(8) + " " + p + " " + text(i * 400), "fr", "s1", 0) for i, p in enumerate(passages)]
    docs += [(400 + i, "spam words " * 30, "en", "junk", 0) for i in range(30)] + [(440, text(50), "en", "junk", 0), (441, None, "en", None, 0), (441, text(60), None, None, 0)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == brute_pipeline(docs, passages)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts[s] for s in range(40)) <= 1 and len({(r["shard"], r["slot"]) for r in got}) == len(got) > 100
