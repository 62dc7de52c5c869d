"""Conversation repair against exhaustive search, language id on held-out text, divergence of sources against plain loops."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.llm import conversation_repair as repair
from patchloom.llm import language_id, source_divergence


def cheapest_by_dijkstra(rows):
    """Uniform-cost search over whole paths in order of (cost, audit)."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return audit
        if (i, q) in done:
            continue
        done.add((i, q))
        after = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}[q][1]
        heapq.heappush(heap, (cost + 2, audit + "I", i, after))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q))
            if fault < repair.DUPLICATE:
                heapq.heappush(heap, (cost + 2 + fault, audit + "R", i + 1, after))
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, initial))
                if kept is not None:
                    heapq.heappush(heap, (cost + fault, audit + "K", i + 1, kept))


def random_rows(draw, n, clean):
    return [("ua"[i % 2], 0) if draw.random() < clean else (draw.choice("suuaa-"), draw.choices([0, 1, 2, 3], [6, 2, 1, 1])[0]) for i in range(n)]


def test_edits_are_the_cheapest_and_first():
    draw = random.Random(8)
    for n in [*range(9)] * 60 + [25, 40]:
        rows = random_rows(draw, n, 0.3)
        assert repair.cheapest_edits(rows) == repair.audit(rows) == cheapest_by_dijkstra(rows), rows


def test_cut_conversations_have_the_result_of_one_search():
    draw, cuts = random.Random(9), 0
    for _ in range(150):
        rows = random_rows(draw, draw.randint(30, 160), draw.choice([0.9, 0.95, 0.98]))
        cuts += len(list(repair.pieces(rows))) - 1
        assert repair.audit(rows) == cheapest_by_dijkstra(rows)
    assert cuts > 150


def test_a_conversation_of_very_many_turns():
    draw = random.Random(10)
    rows = random_rows(draw, 100_000, 0.95)
    edits = repair.audit(rows)
    assert len(edits) - edits.count("I") == len(rows) and edits.count("K") > 80_000


def test_repaired_turns_follow_the_edits(spark):
    rows = [(1, 2, "assistant", "Hm."), (1, 1, "system", "Be brief."), (1, 9, "user", "Why?"), (1, 9, "user", "Why?"), (1, 10, "user", "And"), (2, None, None, None), (3, 1, "tool", "x.")]
    lost = [(4, 1, "user", "Gone.", True), (4, None, "user", "Gone.", True)]
    table = spark.createDataFrame([(*r, False) for r in rows] + lost, "conv_id long, turn long, role string, text string, gone boolean").withColumn("repaired", F.lit(1))
    got = {r["conv_id"]: r for r in repair.repair_conversations(table, gone="gone").collect()}
    # 4 of turns 1 to 10 are there, 9 twice; s-a, a-u is legal, u-u is not
    one = got[1]
    assert [one[c] for c in repair.COUNTS] == [6, 0, 1, 1, 3, 8]
    assert one["audit"] == "KIKKDR" and [tuple(t) for t in one["repaired"]] == [("system", "Be brief."), ("user", ""), ("assistant", "Hm."), ("user", "Why?"), ("assistant", "And")]
    assert (got[2]["blank"], got[2]["audit"], got[2]["repaired"]) == (1, "D", [])
    assert (got[3]["audit"], got[3]["cost"]) == ("D", 3) and (got[4]["audit"], got[4]["cost"], got[4]["repaired"]) == ("", 0, [])


def test_repair_keeps_stated_digest(spark, tmp_path):
    from patchloom.llm.registry import queries

    # a conversation whose rows get no fault by the contract
    conv = next(c for c in range(100) if min(zlib.crc32(f"{c}:{t}".encode()) % 20 for t in (3, 5)) > 4)
    spark.createDataFrame([(conv, 3, "user", "Ok?"), (conv, 5, "assistant", "Yes.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row = queries()["op11_conversation_repair"](spark, str(tmp_path)).first()
    assert (row["gaps"], row["audit"], row["repaired_sha256"]) == (1, "KK", hashlib.sha256(b"user:Ok?\nassistant:Yes.").hexdigest())


LANGS = {"aa": "lorem ipsum dolor sit amet consectetur elit sed", "bb": "kala maja puu vesi jogi mets õun", "cc": "дом река лес поле снег"}


def text_in(draw, lang, n):
    return " ".join(draw.choices(LANGS[lang].split(), k=n))


def test_network_on_held_out_texts(spark):
    draw = random.Random(4)
    rows = [(i, text_in(draw, lang, draw.randint(3, 300)), lang) for i, lang in enumerate(draw.choices(list(LANGS), [6, 2, 1], k=300))]
    rows += [(900 + i, t, lang) for i, (t, lang) in enumerate([(None, "aa"), ("", "aa"), ("12 34 -", "bb"), (text_in(draw, "cc", 30), None), ("д", None), ("7" * 3000 + text_in(draw, "bb", 900), None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).withColumn("windows", F.lit(1))
    network = language_id.train(language_id.sample_windows(docs, held_out=F.col("doc_id") % 3 == 1))
    got = {r["doc_id"]: r for r in language_id.predict_language(docs, network, ["doc_id", "lang", "windows"]).collect()}
    held = [r for i, r in got.items() if i < 300 and i % 3 == 1]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held) and all(0 < r["score"] <= 1 for r in held)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901, 902)] == [("und", 0)] * 3
    assert got[903]["lang_pred"] == "cc" and got[904]["lang_pred"] in LANGS and got[905]["lang_pred"] == "bb" and len(got) == len(rows)


def test_every_byte_is_in_a_window():
    for n in (1, 252, 253, 254, 506, 507, 2000):
        text = bytes(i % 251 for i in range(n))
        starts = language_id.window_starts(n)
        codes, sizes = language_id.windows_of(text, starts)
        assert codes.shape == (len(starts), language_id.WINDOW) and sizes.sum() == n and sizes.min() > 0
        spans = {bytes(int(c) - 1 for c in row[k : k + 4]) for row in codes for k in range(language_id.STEP) if row[k + 3]}
        assert spans == {text[i : i + 4] for i in range(n - 3)}


def test_gradients_and_fast_scoring():
    draw = np.random.default_rng(1)
    network = language_id.ByteNetwork(["x", "y", "z"])
    network.weights = {k: w.astype(np.float64) for k, w in network.weights.items()}
    codes, labels = draw.integers(0, 257, (5, language_id.WINDOW)), np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(network.softmax(network.pooled(codes)[0])[np.arange(5), labels]).mean()
    for name, gradient in network.gradients(codes, labels).items():
        for at in [tuple(draw.integers(0, s) for s in gradient.shape) for _ in range(4)]:
            old = network.weights[name][at]
            network.weights[name][at] = old + 1e-6
            up = loss()
            network.weights[name][at] = old - 1e-6
            assert abs((up - loss()) / 2e-6 - gradient[at]) < 1e-5, name
            network.weights[name][at] = old
    assert np.allclose(network.probabilities(codes), network.softmax(network.pooled(codes)[0]), atol=1e-4)


def test_copies_count_once_in_training_and_samples_are_bounded(spark):
    rows = [(i, "same text of copies", "aa") for i in range(200)] + [(300 + i, f"text number {chr(97 + i % 26)} {i}", "aa") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.sample_windows(docs).count() == 101 and language_id.sample_windows(docs, most=7).count() == 7


def plain_divergence(docs, least, top):
    """Every share of every kept term, in plain loops."""
    own, groups, of_lang, within = Counter(), set(), Counter(), Counter()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in (text or "")).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(" ")
        terms = [t for t in terms if t]
        own.update((lang, source, t) for t in terms)
        of_lang.update((lang, t) for t in terms)
        within.update((lang, t) for t in set(terms))
    kept = defaultdict(list)
    for (lang, term), n in within.items():
        if n >= least:
            kept[lang].append(term)

    def shares(count, lang):
        total = sum(count(t) for t in kept[lang])
        return {t: 1 + 10**9 * (count(t) + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}

    p = {g: shares(lambda t, g=g: own[(*g, t)], g[0]) for g in groups}
    q = {lang: shares(lambda t, lang=lang: of_lang[lang, t], lang) for lang, _ in groups}
    out = set()
    for g in groups:
        lang, source = g
        pairs = [(sum(abs(p[g][t] - p[h][t]) for t in kept[lang]), h[1]) for h in groups if h[0] == lang and h != g]
        terms = [(p[g][t] - q[lang][t], t) for t in kept[lang] if own[(*g, t)] and p[g][t] > q[lang][t]]
        for part, items in (("pair", pairs), ("term", terms)):
            ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ordered if part == "pair" else ordered[:top])}
    return out


@pytest.mark.parametrize("width,tile", [(3, 2), (4096, 256)])
def test_divergence_equals_plain_loops(spark, width, tile):
    draw = random.Random(6)
    words = [f"{a}{b}" for a in "abcdé\U0001f600～" for b in ("x", "Y", "ü", "z7q")]
    docs = [(draw.choice(["en", "en", "fr", None]), draw.choice(["s1", "s2", "s3", "s4", "é", None, ""]), " ".join(draw.choices(words, k=draw.randint(0, 12)))) for _ in range(400)]
    docs += [("xx", "one", "rare"), ("xx", "two", None), ("xx", None, ""), ("yy", "only", None)] + [("en", "hot", "ax ax bx")] * 150
    table = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5).withColumn("term", F.lit(1))
    audit = source_divergence.Audit(table, 12)
    got = {(r["lang"], r["source"], part, r["item"], r["value"], r["rank"]) for part, df in (("pair", source_divergence.source_distances(audit, width, tile)), ("term", source_divergence.distinctive_terms(audit, 4))) for r in df.collect()}
    assert got == plain_divergence(docs, 12, 4)
