"""Problem 9: mixing sources to target weights with capped repetition."""

from __future__ import annotations

import heapq
import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import spelling as S
from ..session import checkpointed, small, table
from .chunk_tokens import token_counts
from .common import cumulative_before

SEED = 9
#: With as few documents left that may still fit, a task per pattern and source ends the selection.
LOCAL_DOCUMENTS = 500_000


class Flow:
    """Min-cost max-flow over integer capacities and costs: a blocking flow for each distance from the source."""

    def __init__(self, n: int):
        self.head: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.price = [0] * n

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.head[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def _reduced(self, x: int, e: int) -> int:
        return self.cost[e] + self.price[x] - self.price[self.to[e]]

    def _reprice(self, s: int, t: int) -> bool:
        """Shortest reduced distances from ``s`` become part of the prices; False if ``t`` can't be reached."""
        far, queue = {s: 0}, [(0, s)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in self.head[x]:
                if self.cap[e] > 0 and (n := d + self._reduced(x, e)) < far.get(self.to[e], math.inf):
                    far[self.to[e]] = n
                    heapq.heappush(queue, (n, self.to[e]))
        if t not in far:
            return False
        self.price = [p + min(far.get(x, far[t]), far[t]) for x, p in enumerate(self.price)]
        return True

    def _layers(self, s: int) -> list[int]:
        layer, front = [-1] * len(self.head), [s]
        layer[s] = 0
        while front:
            ahead = []
            for x in front:
                for e in self.head[x]:
                    y = self.to[e]
                    if layer[y] < 0 and self.cap[e] > 0 and self._reduced(x, e) == 0:
                        layer[y] = layer[x] + 1
                        ahead.append(y)
            front = ahead
        return layer

    def _push(self, s: int, t: int, layer: list[int]) -> None:
        """A blocking flow along the layers, each arc tried once."""
        at, path = [0] * len(self.head), []
        while True:
            x = self.to[path[-1]] if path else s
            if x == t:
                least = min(self.cap[e] for e in path)
                for e in path:
                    self.cap[e] -= least
                    self.cap[e ^ 1] += least
                del path[next(i for i, e in enumerate(path) if self.cap[e] == 0) :]
                continue
            while at[x] < len(self.head[x]):
                e = self.head[x][at[x]]
                if self.cap[e] > 0 and layer[self.to[e]] == layer[x] + 1 and self._reduced(x, e) == 0:
                    path.append(e)
                    break
                at[x] += 1
            else:
                if not path:
                    return
                at[self.to[path.pop() ^ 1]] += 1

    def run(self, s: int, t: int) -> None:
        while self._reprice(s, t):
            while (layer := self._layers(s))[t] >= 0:
                self._push(s, t, layer)


def route(supply: list[tuple[tuple[str, ...], int]], targets: list[dict]) -> tuple[dict, dict]:
    """Route token capacity of membership patterns to source quotas.

    supply: (pattern, tokens); targets: ``source, weight, max_repeats, total``.
    Returns (tokens by (pattern, source), shortfall by source). The k-th use
    of a pattern's tokens costs k, so repetition is spread evenly; a source
    takes a pattern at most ``max_repeats`` times.
    """
    by = {t["source"]: t for t in targets}
    quota = {s: max(0, math.ceil(t["weight"] * t["total"])) for s, t in by.items()}
    names = sorted(by)
    flow = Flow(2 + len(supply) + len(names))
    source_node = {s: 2 + len(supply) + i for i, s in enumerate(names)}
    ends = {s: flow.arc(source_node[s], 1, quota[s], 0) for s in names}
    arcs: dict = {}
    for i, (pattern, tokens) in enumerate(supply):
        own = [s for s in pattern if s in by]
        if not own or tokens <= 0:
            continue
        most = max(by[s]["max_repeats"] for s in own)
        needed = math.ceil(sum(quota[s] for s in own) / tokens)
        for k in range(1, min(most, needed) + 1):
            flow.arc(0, 2 + i, tokens, k)
        for s in own:
            for k in range(1, min(by[s]["max_repeats"], math.ceil(quota[s] / tokens)) + 1):
                arcs.setdefault((pattern, s), []).append(flow.arc(2 + i, source_node[s], tokens, k))
    flow.run(0, 1)
    used = {ps: sum(flow.cap[e ^ 1] for e in es) for ps, es in arcs.items()}
    return used, {s: flow.cap[e] for s, e in ends.items()}


def mixture_plan(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, report) for documents ``doc_id, sources, n_tokens``.

    plan: ``pattern, source, tokens, supply``; report: one row per source with
    ``target_tokens, available_tokens, planned_tokens, short``. Documents are
    aggregated by membership pattern (map-side combined, so a source with a
    third of all documents is one row); only targets and patterns, a row for
    each set of target sources that some document has, reach the driver.

    Defined cases: null sources belong to no pattern; null or negative token
    counts are 0; targets with null or negative weights or repeats count as 0;
    of repeated targets the greatest values hold; a source without documents
    is short when its target is positive; empty targets give an empty plan.
    """
    spark = docs.sparkSession
    t = targets.where("source IS NOT NULL").groupBy("source").agg(
        F.greatest(F.coalesce(F.max("target_weight"), F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"), F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total")
    ).collect()
    targets_ = [r.asDict() for r in t]
    names = F.array(*[F.lit(r["source"]) for r in targets_]) if targets_ else F.array().cast("array<string>")
    pattern = F.array_sort(F.array_intersect(F.coalesce("sources", F.array().cast("array<string>")), names))
    rows = docs.groupBy(pattern.alias("pattern")).agg(F.sum(F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0))).alias("tokens")).where(F.size("pattern") > 0).collect()
    supply = sorted((tuple(r["pattern"]), r["tokens"]) for r in rows)
    used, short = route(supply, targets_)
    stock = dict(supply)
    plan = [(list(p), s, tokens, stock[p]) for (p, s), tokens in used.items() if tokens > 0]
    report = [
        (r["source"], r["weight"], r["max_repeats"], r["total"], r["weight"] * r["total"], sum(n for p, n in supply if r["source"] in p), sum(x for (p, s), x in used.items() if s == r["source"]), short[r["source"]] > 0)
        for r in targets_
    ]
    return (
        spark.createDataFrame(plan, "pattern array<string>, source string, tokens long, supply long"),
        spark.createDataFrame(report, "source string, target_weight double, max_repeats int, total_tokens long, target_tokens double, available_tokens long, planned_tokens long, short boolean"),
    )


def _first_fit(t: pa.Table) -> pa.Table:
    """Add ``chosen`` to the documents of one pattern and source: in seeded order, each that still fits the rest."""
    # the hash ranges of cumulative_before are in unsigned order
    t = t.append_column("order", t["position"].cast(pa.uint64(), safe=False)).sort_by([("order", "ascending"), ("doc_id", "ascending")]).drop_columns("order")
    left, chosen = t["rest"][0].as_py(), []
    for n in t["n_tokens"].to_pylist():
        chosen.append(n <= left)
        left -= n if chosen[-1] else 0
    return t.append_column("chosen", pa.array(chosen, pa.bool_()))


def _floor_div(a, b):
    return F.call_function("div", a - F.pmod(a, b), b)


def _per_pattern(plan: DataFrame) -> DataFrame:
    """``p, supply, steps, most``: the sources of a pattern side by side, each with its interval of the pattern's tokens and its greatest number of uses."""
    known = F.array_sort(F.collect_set("source").over(W.partitionBy()))
    one = plan.select(F.concat_ws("|", F.array_sort(F.array_intersect("pattern", known))).alias("p"), "source", "tokens", "supply")
    begin = F.coalesce(F.sum("tokens").over(W.partitionBy("p").orderBy("source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    step = F.struct("source", "begin", "tokens", (-_floor_div(-F.col("tokens"), F.col("supply"))).alias("cap"))
    whole = one.withColumn("begin", begin).groupBy("p", "supply").agg(F.sort_array(F.collect_list(step)).alias("steps"), F.sum("tokens").alias("all"))
    return whole.select("p", "supply", "steps", (-_floor_div(-F.col("all"), F.col("supply"))).alias("most"))


def select_documents(docs: DataFrame, plan: DataFrame, seed: int = SEED, local_documents: int = LOCAL_DOCUMENTS) -> DataFrame:
    """``doc_id, source, repeats, n_tokens``: how often each source uses each document, in seeded order.

    The documents of a pattern lie in one seeded order, end to end and over
    and over again; its sources take consecutive intervals of that line as
    long as their tokens in the plan, and use each copy that lies within. Uses
    of a document by all sources together thus differ by one at most, and none
    is used more often than the plan's tokens need: no document exceeds its
    cap, whatever sources it has.

    Copies across the end of an interval leave a rest. It is filled with the
    documents that have a use left, in order, each that still fits; where a
    pattern has several sources, each such document is offered to one of them,
    by lot. No quota is exceeded, and what stays empty of a rest is less than
    the shortest document offered to it and not taken.

    The running token counts are distributed over hash ranges; the plan has a
    row per pattern and source. Of the documents that fit a rest, only the
    first of each size that fit it together can follow: at most
    rest x (1 + ln rest), however many there are, and a rest is shorter than
    two documents. With at most ``local_documents`` of them, one task per
    pattern and source ends the work by the same rule; else a pass takes those
    before the first that exceeds the rest, and so on.

    Defined cases: documents without a planned source or tokens aren't used; an
    empty plan uses none; equal doc_ids are documents of their own, whose uses
    come out together.
    """
    names = [r["source"] for r in plan.select("source").distinct().collect()]
    if not names:
        return docs.select("doc_id", F.lit("").alias("source"), F.lit(0).cast("long").alias("repeats"), "n_tokens").limit(0)
    pattern = F.concat_ws("|", F.array_sort(F.array_intersect("sources", F.array(*[F.lit(s) for s in names]))))
    rows = docs.where(F.col("n_tokens") > 0).select("doc_id", "n_tokens", pattern.alias("p")).join(small(_per_pattern(plan)), "p")
    rows = rows.withColumn("position", F.xxhash64("doc_id", "p", F.lit(seed)))
    line = cumulative_before(rows, ["p"], F.col("position"), "doc_id", F.col("n_tokens"))
    end = lambda s: s["begin"] + s["tokens"] - F.col("before") - F.col("n_tokens")
    within = lambda s: F.greatest(_floor_div(end(s), F.col("supply")) + _floor_div(F.col("before") - s["begin"], F.col("supply")) + 1, F.lit(0))
    line = line.withColumn("uses", F.transform("steps", within)).drop("before")
    line = checkpointed(line)
    used = line.select("doc_id", "p", "n_tokens", F.posexplode("uses").alias("i", "repeats"), "steps").select("doc_id", "p", F.col("steps")[F.col("i")]["source"].alias("source"), "repeats", "n_tokens").where("repeats > 0")
    parts = [used.select("doc_id", "source", "repeats", "n_tokens")]

    taken = used.groupBy("p", "source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("taken"))
    one = _per_pattern(plan).select("p", F.posexplode("steps").alias("i", "s")).select("p", "i", F.col("s.source").alias("source"), F.col("s.tokens").alias("tokens"))
    rests = one.join(taken, ["p", "source"], "left").withColumn("rest", F.col("tokens") - F.coalesce("taken", F.lit(0)))
    rests = checkpointed(rests.groupBy("p").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "rest"))), lambda x: x["rest"]).alias("rests")))
    spare = line.where(F.aggregate("uses", F.lit(0).cast("long"), lambda a, x: a + x) < F.col("most")).join(small(rests), "p")
    able = F.filter(F.sequence(F.lit(0), F.size("steps") - 1), lambda i: (F.col("uses")[i] < F.col("steps")[i]["cap"]) & (F.col("rests")[i] >= F.col("n_tokens")))
    lot = F.get("able", F.pmod(F.xxhash64("position"), F.size("able")).cast("int"))
    spare = spare.withColumn("able", able).where(F.size("able") > 0).withColumn("i", lot)
    rows = spare.select("doc_id", F.col("steps")[F.col("i")]["source"].alias("source"), "n_tokens", "p", F.col("rests")[F.col("i")].alias("rest"), "position")

    fits = F.col("before") + F.col("n_tokens") <= F.col("rest")
    once = lambda df: df.select("doc_id", "source", F.lit(1).cast("long").alias("repeats"), "n_tokens")
    while True:
        able_ = cumulative_before(rows.where("n_tokens <= rest"), ["p", "source", "n_tokens"], F.col("position"), "doc_id", F.col("n_tokens"))
        rows = checkpointed(able_.where(fits).drop("before"))
        if rows.count() <= local_documents:
            break
        done = checkpointed(cumulative_before(rows, ["p", "source"], F.col("position"), "doc_id", F.col("n_tokens")).withColumn("chosen", fits).drop("before"))
        parts.append(once(done.where("chosen")))
        got = done.where("chosen").groupBy("p", "source").agg(F.sum("n_tokens").alias("got"))
        rows = done.where("NOT chosen").join(got, ["p", "source"]).withColumn("rest", F.col("rest") - F.col("got")).drop("got", "chosen")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    last = rows.groupBy("p", "source").applyInArrow(_first_fit, kinds + ", chosen boolean")
    parts.append(once(last.where("chosen")))
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "source", "n_tokens").agg(F.sum("repeats").alias("repeats")).select("doc_id", "source", "repeats", "n_tokens")


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, sources, n_tokens`` of all documents."""
    docs = table(spark, sf_dir, "documents")
    sizes = token_counts(docs.select("doc_id", "text"))
    sources = docs.select("doc_id", S.word("source").alias("source"))
    sources = sources.groupBy("doc_id").agg(F.collect_set("source").alias("sources"))
    return checkpointed(sizes.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")).join(sources, "doc_id"))


def mixture_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets with clean source names."""
    return table(spark, sf_dir, "mixture_targets").withColumn("source", S.word("source"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, available, planned and reached tokens and shares of each source."""
    docs = sized_documents(spark, sf_dir)
    plan, report = mixture_plan(docs, mixture_targets(spark, sf_dir))
    got = select_documents(docs, plan).groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("actual_tokens"), F.max("repeats").alias("most_repeats"))
    total = F.broadcast(got.agg(F.sum("actual_tokens").alias("mix_tokens")))
    return report.join(F.broadcast(got), "source", "left").crossJoin(total).select(
        *report.columns, F.coalesce("actual_tokens", F.lit(0)).alias("actual_tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), (F.coalesce("actual_tokens", F.lit(0)) / F.col("mix_tokens")).alias("actual_share")
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that fall short of their target even when repeated as often as allowed."""
    _, report = mixture_plan(sized_documents(spark, sf_dir), mixture_targets(spark, sf_dir))
    return report.where("short").select("source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: each chosen document with its number of uses."""
    docs = sized_documents(spark, sf_dir)
    plan, _ = mixture_plan(docs, mixture_targets(spark, sf_dir))
    return select_documents(docs, plan)


def p9_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the mix breaks: a document above its cap, a source above its plan, or a rest that a document not used up would still fit."""
    docs = sized_documents(spark, sf_dir)
    plan, report = mixture_plan(docs, mixture_targets(spark, sf_dir))
    used = checkpointed(select_documents(docs, plan))
    caps = small(checkpointed(report.select("source", "max_repeats", "planned_tokens", "available_tokens")))
    own = docs.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode("sources").alias("source")).join(caps, "source")
    both = own.join(used.select("doc_id", "source", "repeats"), ["doc_id", "source"], "left").withColumn("repeats", F.coalesce("repeats", F.lit(0)))
    per = both.groupBy("doc_id").agg(F.sum("repeats").alias("n"), F.max("max_repeats").alias("most"))
    most = F.least("max_repeats", F.ceil(F.col("planned_tokens") / F.col("available_tokens")))
    sums = both.groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("got"), F.max("planned_tokens").alias("planned"), F.min(F.when(F.col("repeats") < most, F.col("n_tokens"))).alias("shortest"))
    row = lambda df, rule, entity: df.select(F.lit(rule).alias("rule"), F.col(entity).cast("string").alias("entity"))
    return row(both.where("repeats > max_repeats"), "source_cap", "doc_id").unionByName(row(per.where("n > most"), "cap", "doc_id")).unionByName(row(sums.where("got > planned"), "plan", "source")).unionByName(row(sums.where("planned - got >= shortest"), "rest", "source"))
