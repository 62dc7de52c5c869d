"""Every registered query on one hard table and on empty ones: against its SQL, or else against direct computations."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from patchloom.llm import common, language_model, quality_model, registry, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["n_words", "matches", "score", "uid", "row", "key", "label", "size", "start", "target", "fp", "component", "whole", "anchors", "__uid", "toxic", "quality", "slot", "rank", "term", "gone", "value", "item", "windows"]
TURNS = "conv_id long, turn long, role string, text string"
LONG = 450_000


def rows():
    draw = random.Random(12)
    words = [f"w{i}" for i in range(300)] + ["Émile", "#", "a*b"]
    text = lambda n: " ".join(draw.choices(words, k=n))
    passage, license_ = text(70), "Released under the MIT License. Licensed under the Apache License, Version 2.0"
    out = [(i, text(draw.randint(1, 120)) + (" idiot" * (i % 5 == 0)), "en", f"s{i % 4}", 1) for i in range(40)]
    out += [(40 + i, text(5) + " " + passage + " " + text(i), "fr", "s0", None) for i in range(6)]
    out += [(50, out[3][1], "en", "s1", 0), (50, out[4][1], "en", None, 0), (50, out[4][1], "en", None, 0), (3, out[3][1], "en", "s1", 0)]
    out += [(60, None, "en", "s2", None), (61, "", "en", None, 0), (62, " \n\t ", "de", "s2", 0), (63, license_, "en", "s9", 0), (64, "same line\nsame line\nother", "en", "s9", 0), (65, "x", None, "tiny", 1)]
    out += [(None, passage, "en", "s1", 0), (None, None, None, None, None), (None, text(30), "en", "s1", 0)]
    return out, passage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hard"))
    docs, passage = rows()
    spark.createDataFrame(docs, SCHEMA).repartition(4).withColumns({c: F.lit(1) for c in CLASH}).write.parquet(f"{path}/documents.parquet")
    items = [(1, passage), (2, "w1 w2"), (3, None), (4, ""), (11, " ".join(passage.split()[10:40]) + " tail"), (None, "w5 w6 w7")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(40)] + [(5, 1, 1), (None, 1, 1), (60, None, None), (999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(conversation_rows(), TURNS).repartition(3).withColumns({c: F.lit(1) for c in ("gone", "gaps", "audit", "copy")}).write.parquet(f"{path}/conversations.parquet")
    return path


def conversation_rows():
    draw = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "unknown", "", None, "User", "\u00e9t\u00e9"]
    texts = ["Yes.", "Well, no!", "Is it so? ", "cut off", "", " \t", None, "\u00dcber\n", "Stop.\x0b", "\xa0", "..."]
    out = [(c, t, draw.choices(roles, [9, 9, 3, 1, 1, 1, 1, 1, 1])[0], draw.choices(texts, [9, 6, 5, 3, 1, 1, 1, 1, 1, 1, 1])[0]) for c in range(150) for t in range(draw.randint(1, 9))]
    out += [(200, None, "user", "First?"), (200, None, "assistant", "Second."), (200, 5, "user", "Third."), (200, 5, "user", "Third."), (200, -2, "assistant", "No.")]
    out += [(None, 0, "user", "Whose?"), (None, 1, "assistant", "Nobody's."), (None, None, None, None), (201, None, None, None), (202, None, "user", ".")]
    return out + [(300, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(120)]


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "none"
    return str(value) if isinstance(value, (bool, str)) else f"{float(value):.9g}"


def table(records, columns):
    return Counter(tuple(plain(r[c]) for c in sorted(columns)) for r in records)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, folder, name):
    found = registry.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = table((dict(zip(names, r)) for r in result.fetchall()), names)
    assert sorted(names) == sorted(found.columns) and table(found.collect(), names) == want and (want.total() == len(rows()[0]) or name.startswith(("op11", "op13")))


def held_out(i, by, rest):
    return i is not None and zlib.crc32(str(i).encode()) % by == rest


def test_op4_holds_what_the_contract_states(spark, folder):
    docs, _ = rows()
    got = registry.queries()["op4_log_bilinear_scores"](spark, folder)
    tokens = lambda t: (t or "").encode().lower().split() + [language_model.END]
    counts = Counter(w for i, t, *_ in docs if not held_out(i, 5, 1) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, *_ in docs:
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens(t))
        want[i, held_out(i, 5, 1), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, f"{base:.6g}"] += 1
    records = got.collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.6g}") for r in records) == want
    assert all(r["score"] < 0 for r in records)


def test_op5_and_op2_score_every_row(spark, folder):
    docs, _ = rows()
    ids = Counter(d[0] for d in docs)
    got = registry.queries()["op5_ftrl_quality"](spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == ids
    assert all(0 < r["score"] < 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held_out(r["doc_id"], 4, 2) for r in got)
    got = registry.queries()["op2_toxicity_chain"](spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == ids
    assert all(r["toxic"] == (r["score"] > toxicity.THRESHOLD) and r["score"] == r["p_toxic"] and r["held_out"] == held_out(r["doc_id"], 4, 2) for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert np.mean([score[i] for i in range(0, 40, 5)]) > 0.5 > np.mean([score[i] for i in range(40) if i % 5])


def test_chain_scores_equal_a_plain_loop(spark, folder):
    sample = quality_model.labelled_sample(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), "toxic", 100)
    model = toxicity.train_chain(sample)
    texts = [t.encode() if t else t for _, t, *_ in rows()[0]]
    got = np.array(model.score(texts)).T
    n = len(model.vocabulary)
    for text, scores in zip(texts, got):
        times = Counter(f for w in common.alnum_words(text) for f in toxicity.word_features(w) if f in model.vocabulary)
        earlier = []
        for weights, score in zip(model.weights.values(), scores):
            margin = weights[-1] + sum(weights[model.vocabulary[f] + k * n] for f, c in times.items() for k in range(min(c, toxicity.TIMES)))
            margin += sum(w * p for w, p in zip(weights[toxicity.TIMES * n :], earlier))
            earlier.append(1 / (1 + math.exp(-max(-20, min(20, margin)))))
            assert abs(earlier[-1] - score) < 1e-9


def test_op6_links_and_names(spark, folder):
    docs, _ = rows()

    def fingerprint(text):
        words = (text or "").encode().lower().split()
        n = min(4, len(words))
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[p : p + n]), 42) for p in range(len(words) - n + 1)] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(t) for _, t, *_ in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                group = [group[b] if g == group[a] else g for g in group]
    lowest = {g: min((d[0] for d, h in zip(docs, group) if h == g and d[0] is not None), default=None) for g in group}
    want = Counter((d[0], f"{p:016x}", lowest[g]) for d, p, g in zip(docs, prints, group))
    got = registry.queries()["op6_simhash_near_duplicates"](spark, folder).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_op9_law(spark, folder):
    docs, _ = rows()
    got = registry.queries()["op9_balanced_label_shards"](spark, folder).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(40)) and max(counts.values()) - min(counts[s] for s in range(40)) <= 1
    assert {(r["shard"], r["slot"]) for r in got} == {(s, k) for s, n in counts.items() for k in range(n)}


def test_a_very_long_text(spark, tmp_path):
    draw = random.Random(5)
    words = [f"v{draw.randrange(5000)}" for _ in range(LONG)]
    words[1000:1400] = ["again"] * 400
    texts = [" ".join(words), " ".join(words[-100:]), "gnu general public license " * 2, " ".join(words)]
    assert len(texts[0]) > common.SLICE_BYTES
    spark.createDataFrame([(70 + i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(words[-20:])), (2, "again " * 13)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(70, 1, 0), (71, 0, 1), (72, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", texts[0]), (1, 1, "assistant", texts[1] + "."), (2, 0, "user", "Short?")], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {name: query(spark, str(tmp_path)) for name, query in registry.queries().items()}
    assert {r["conv_id"]: r["truncated"] for r in found.pop("op11_conversation_repair").collect()} == {1: 1, 2: 0} and found.pop("op13_source_divergence").count() == 0
    got = {name: {r["doc_id"]: r for r in df.collect()} for name, df in found.items()}
    assert all(set(x) == {70, 71, 72, 73} for x in got.values())
    one = got["op1_benchmark_decontamination"]
    assert [(one[i]["n_words"], one[i]["n_hit"], one[i]["contaminated"]) for i in (70, 71, 73)] == [(LONG, 420, False), (100, 20, True), (LONG, 420, False)]
    assert [got["op10_relative_lz_dedup"][i]["n_removed"] for i in range(70, 74)] == [0, 100, 0, LONG]
    assert got["op3_host_quality_rules"][70]["n_words"] == LONG and got["op3_host_quality_rules"][70]["n_repeat_words"] >= 400
    assert got["op4_log_bilinear_scores"][70]["n_tokens"] == LONG + 1 and got["op7_license_templates"][70]["n_words"] == LONG
    six = got["op6_simhash_near_duplicates"]
    assert six[70]["fingerprint"] == six[73]["fingerprint"] and six[73]["component_id"] == 70
    assert got["op8_source_mix"][70]["size"] == LONG and got["op9_balanced_label_shards"][70]["size"] == len(texts[0]) + 16
    assert got["op12_byte_network_language"][70]["lang_pred"] == "en" and got["op12_byte_network_language"][70]["score"] == 1
    assert got["op5_ftrl_quality"][70]["score"] == got["op5_ftrl_quality"][73]["score"] and got["op2_toxicity_chain"][70]["score"] == got["op2_toxicity_chain"][73]["score"]


def test_no_documents(spark, folder, tmp_path):
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    for name, query in registry.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_columns_of_any_type_come_through(spark):
    from patchloom.llm import decontaminate, mixing, quality_rules, simhash

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [(i, " ".join(f"{x}{k}" for k in range(30)), "s") for i, x in enumerate("ab")]
        extra = {"at": F.timestamp_seconds(F.lit(5)), "ntz": F.lit("2024-01-01").cast("timestamp_ntz"), "day": F.lit("2024-01-01").cast("date"), "m": F.create_map(F.lit("k"), F.lit(1)), "dec": F.lit("1.5").cast("decimal(9,2)")}
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(extra)
        items = spark.createDataFrame([(1, "none of these")], "item_id long, text string")
        want = sorted(docs.collect(), key=lambda r: r["doc_id"])
        for found in (simhash.keep_one(docs), quality_rules.keep_good(docs), decontaminate.remove_contaminated(docs, items), mixing.take_mix(docs)):
            assert found.schema.simpleString() == docs.schema.simpleString() and sorted(found.collect(), key=lambda r: r["doc_id"]) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
