"""Shards with equal row counts by balanced label propagation, which keeps linked documents together.

Documents of equal text are linked through their text's hash, so n copies have n links and not n squared. Each linked
document begins with a label (its shard) dealt by doc_id. In every round, a group's votes are counted from the labels that
its members have by then, joined with the room that all labels leave: it asks for the label of most of its members that has
room for the rest of them, or else any label with room for all. Moves are accepted by a threshold on a hash of the group,
which a histogram of the moves asked for (LEVELS counts a shard) sets so that no shard gets more than its room; where not
even the lowest count fits, the first group is accepted. What moves leaves room where it was. The rounds end when no group
has two labels, or none that has can move; each lowers the number of cut links. Groups that could not move then leave
their places and ask for room as a whole, in the same way. Documents without links don't hold a place against a group: in
the end they are swapped into the places that the groups leave.

Groups that fill much of a shard, a bounded number, are placed first, the largest before. Those larger than a shard lie
side by side over as many shards as they need. A group that fits into no shard's room keeps one label, runs over the
shard's border, and pushes what follows. So a group is parted only at a border (one at most each) or if it is larger
than a shard; cut_groups counts both.

Law `rows`. A null text has no bytes and no links. Repeated rows each have a place. With fewer documents than shards
some shards stay empty; an empty table gives an empty result. Texts are only hashed, however long. Other columns are not
read, whatever their names, unless they are carried. Ties among votes fall by a hash. Reruns agree on input in the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, number_rows

SHARDS = 40
#: Groups of more than this part of a shard's rows are placed by the driver; there are fewer than SHARDS times LARGE and a few.
LARGE = 8
#: Steps of the threshold by which a shard's moves are accepted.
LEVELS = 512


def _place(group: tuple[int, list[int]], room: list[int]) -> int:
    """The label of a group (members, labels by votes) in the room left, which it takes; the roomiest if it fits nowhere."""
    members, wanted = group
    roomiest = max(range(len(room)), key=room.__getitem__)
    label = next((b for b in wanted if room[b] >= members), roomiest)
    room[label] -= members
    return label


def _accept(asks: DataFrame, room: list[int], turn: int) -> DataFrame | None:
    """asks (key, want, moves, ...), written, with `accepted`: as many as the room of each label takes, by a hash; None if there are none."""
    level = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(LEVELS)).cast("int")
    counts = asks.groupBy("want", level.alias("level")).agg(F.sum("moves").alias("moves"), F.min(F.struct(F.xxhash64("key", F.lit(turn + 1)).alias("draw"), "key")).alias("first"))
    below, firsts = [0] * len(room), []
    left = list(room)
    lines: dict[int, list] = {}
    for r in counts.collect():  # LEVELS rows a shard at most
        lines.setdefault(r["want"], []).append(r)
    for want, rows in lines.items():
        for r in sorted(rows, key=lambda r: r["level"]):
            if r["moves"] > left[want]:
                break
            left[want] -= r["moves"]
            below[want] = r["level"] + 1
        if not below[want]:
            firsts.append(min(r["first"] for r in rows)["key"])
    if not lines:
        return None
    limit = F.get(F.array(*[F.lit(x) for x in below]), F.col("want"))
    return asks.withColumn("accepted", (level < limit) | F.col("key").isin(firsts))


def propagate(groups: DataFrame, firsts: list[int]) -> tuple[DataFrame, list[int]]:
    """key and label of every group (key, members, votes), and the rows that groups hold of each label.

    firsts are the places at which shards begin, and the number of rows.
    """
    spark, shards = groups.sparkSession, len(firsts) - 1
    room = [b - a for a, b in zip(firsts, firsts[1:])]
    least = max(1, firsts[-1] // shards)
    held, placed = [0] * shards, []

    def place(rows: list) -> None:
        for r in rows:
            label = _place((r["members"], [v["label"] for v in r["votes"]]), room)
            held[label] += r["members"]
            placed.append((r["key"], label))

    large = sorted(groups.where(F.col("members") * LARGE > least).collect(), key=lambda r: (-r["members"], r["key"]))
    over = [r for r in large if r["members"] > max(room)]
    taken = sum(r["members"] for r in over)
    held[0] += taken
    placed += [(r["key"], 0) for r in over]
    room = [max(0, b - max(a, taken)) for a, b in zip(firsts, firsts[1:])]
    place(large[len(over) :])
    whole = list(room)  # for all smaller groups

    def leftover(state: DataFrame) -> list[int]:
        now = {r["label"]: r["n"] for r in state.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        return [w - now.get(b, 0) for b, w in enumerate(whole)]

    def counted(state: DataFrame, left: list[int]) -> DataFrame:
        """Groups with their votes, the label they ask for, if any, and how many members would move to it."""
        vote = F.struct(F.col("n"), F.xxhash64("key", "label").alias("draw"), F.col("label"))
        found = state.groupBy("key").agg(F.sum("n").alias("members"), F.sort_array(F.collect_list(vote), asc=False).alias("votes"))
        rooms = F.array(*[F.lit(x).cast("long") for x in left])
        own = F.get(F.filter("votes", lambda v: F.get(rooms, v["label"]) >= F.col("members") - v["n"]), F.lit(0))
        any_ = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda b: F.get(rooms, b) >= F.col("members"))
        dealt = F.when(F.size(any_) > 0, F.get(any_, F.pmod(F.xxhash64("key", F.lit(turn)), F.size(any_)).cast("int")))
        return found.withColumn("want", F.coalesce(own["label"], dealt)).withColumn("moves", F.col("members") - F.coalesce(own["n"], F.lit(0)))

    state, settled, turn = materialize(groups.where(F.col("members") * LARGE <= least).select("key", F.inline("votes")).select("key", "label", "n")), [], 0
    while True:
        groups_now = materialize(counted(state, leftover(state)))
        split = F.size("votes") > 1
        step = _accept(groups_now.where(split & F.col("want").isNotNull()), leftover(state), turn)
        if step is None:
            break
        moved = step.where("accepted").select("key", F.col("want").alias("to"))
        joined = groups_now.join(materialize(moved), "key", "left")
        one = lambda label, n: F.array(F.struct(label.cast("int").alias("label"), n.alias("n")))
        now = F.when(F.col("to").isNotNull(), one(F.col("to"), F.col("members"))).otherwise(F.transform("votes", lambda v: F.struct(v["label"].alias("label"), v["n"].alias("n"))))
        state = materialize(joined.select("key", F.inline(now)), done_with=[state, groups_now])
        turn += 1
    # by chance more groups may have begun whole at a label than it has places: the last ones by a hash leave
    level = F.pmod(F.xxhash64("key"), F.lit(LEVELS)).cast("int")
    calm = groups_now.where(~split).select("key", F.get("votes", F.lit(0))["label"].alias("label"), "members", "votes", level.alias("level"))
    excess = [n - w for n, w in zip(_by_label(calm, shards), whole)]
    stay = [LEVELS] * shards
    if any(e > 0 for e in excess):
        for r in sorted(calm.groupBy("label", "level").agg(F.sum("members").alias("n")).collect(), key=lambda r: -r["level"]):
            if excess[r["label"]] > 0:
                excess[r["label"]] -= r["n"]
                stay[r["label"]] = r["level"]
    calm = materialize(calm.withColumn("stays", F.col("level") < F.get(F.array(*[F.lit(x) for x in stay]), F.col("label"))))
    settled.append(calm.where("stays").select("key", "label", "members"))
    waiting = materialize(groups_now.where(split).select("key", "members", "votes").unionByName(calm.where("not stays").select("key", "members", "votes")))
    room = [w - n for w, n in zip(whole, _by_label(settled[0], shards))]
    while True:
        rooms = F.array(*[F.lit(x).cast("long") for x in room])
        any_ = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda b: F.get(rooms, b) >= F.col("members"))
        asks = waiting.withColumn("want", F.when(F.size(any_) > 0, F.get(any_, F.pmod(F.xxhash64("key", F.lit(turn)), F.size(any_)).cast("int")))).withColumn("moves", F.col("members"))
        step = _accept(asks.where("want is not null"), room, turn)
        if step is None:
            break
        step = materialize(step)
        settled.append(step.where("accepted").select("key", F.col("want").alias("label"), "members"))
        room = [r - n for r, n in zip(room, _by_label(settled[-1], shards))]
        waiting = materialize(waiting.join(settled[-1].select("key"), "key", "left_anti"))
        turn += 1
    for part in settled:
        held = [h + n for h, n in zip(held, _by_label(part, shards))]
    # each is larger than any room left, so there are fewer than shards
    place(sorted(waiting.collect(), key=lambda r: (-r["members"], r["key"])))
    rows = [F.struct(F.lit(k).cast("long").alias("key"), F.lit(label).cast("int").alias("label")) for k, label in placed]
    labels = spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.range(0).select(F.col("id").alias("key"), F.col("id").cast("int").alias("label"))
    for part in settled:
        labels = labels.unionByName(part.select("key", F.col("label").cast("int").alias("label")))
    return materialize(labels), held


def _by_label(groups: DataFrame, shards: int) -> list[int]:
    """Members of the groups of each label."""
    found = {r["label"]: r["n"] for r in groups.groupBy("label").agg(F.sum("members").alias("n")).collect()}
    return [found.get(b, 0) for b in range(shards)]


def _layout(held: list[int], firsts: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """Where each label's groups begin, and the runs of places they leave free (first, length)."""
    starts, end = [], 0
    for first, n in zip(firsts, held):
        starts.append(max(first, end))
        end = starts[-1] + n
    limit = firsts[-1]
    for b in reversed(range(len(held))):
        starts[b] = limit = min(starts[b], limit - held[b])
    free, end = [], 0
    for start, n in zip(starts, held):
        free.append((end, start - end))
        end = start + n
    return starts, [*free, (end, firsts[-1] - end)]


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) for every row, and the `carry` columns if asked for."""
    body = F.col(text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit(""))).alias("text_crc32"),
        F.when(body.isNotNull(), F.xxhash64(body)).alias("key"),
        F.monotonically_increasing_id().alias("uid"),
        *[F.col(c).alias(f"__c_{c}") for c in carry],
    )
    rows = materialize(rows)
    n = rows.count()
    firsts = [-(-b * n // shards) for b in range(shards + 1)]
    state = rows.select("uid", "doc_id", "size", "text_crc32", "key", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("start"))
    votes = state.where("key is not null").groupBy("key", F.col("start").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    vote = F.struct(F.col("n"), F.xxhash64("key", "label").alias("draw"), F.col("label"))
    groups = votes.groupBy("key").agg(F.sum("n").alias("members"), F.sort_array(F.collect_list(vote), asc=False).alias("votes")).where("members > 1")
    labels, held = propagate(materialize(groups), firsts)
    state = materialize(state.join(labels, "key", "left"))
    starts, free = _layout(held, firsts)
    linked = number_rows(state.where("label is not null"), ["label", "key", "doc_id", "uid"], "rank")
    shifts = F.array(*[F.lit(start - sum(held[:b])).cast("long") for b, start in enumerate(starts)])
    linked = linked.withColumn("rank", F.col("rank") + F.get(shifts, "label"))
    single = number_rows(state.where("label is null"), ["start", F.xxhash64("doc_id"), "doc_id", "uid"], "rank")
    place, before = F.lit(0).cast("long"), 0
    for first, length in free:
        if length:
            place = F.when(F.col("rank") >= before, F.col("rank") + (first - before)).otherwise(place)
            before += length
    order = linked.unionByName(single.withColumn("rank", place))
    shard = F.expr(f"(rank * {shards}L) div {max(1, n)}L")
    first = F.expr(f"(shard * {max(1, n)}L + {shards - 1}L) div {shards}L")
    out = order.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)
    if carry:
        out = out.join(rows.select("uid", *[f"__c_{c}" for c in carry]), "uid")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"__c_{c}").alias(c) for c in carry])


def cut_groups(assigned: DataFrame) -> DataFrame:
    """Groups of equal texts and how many of them lie in more than one shard (one row)."""
    spread = assigned.groupBy("size", "text_crc32").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard").alias("shards")).where("n > 1")
    return spread.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("shards") > 1).alias("cut"))


def op9_balanced_label_shards(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, under the law `rows`."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
