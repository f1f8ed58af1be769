"""One-to-one matching of predicted and true records.

Greedy matching in which the first unmatched prediction takes the first unmatched truth
of the same key is, for equality of keys, ranking both sides within the key: equal ranks
are a pair.  Both sides are one table, shuffled once by document and the keys that all
passes share; every pass ranks what the passes before left, where it lies.  Matching by
tolerance is no equivalence and stays ordered inside a group (tolerance_match).
"""

from __future__ import annotations

import bisect
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tablewright.functions import strings
from tablewright.operators import dictionary, ranks, similarity
from tablewright.plans.stages import settle, spread


def records(pred: DataFrame, gold: DataFrame, doc: list[str], passes: list[list[str]], columns: list[str] | None = None, order: str = "ord") -> DataFrame:
    """Every record once: matched pairs, lone predictions and lone truths.

    doc..., p_ord, g_ord, pass_no (null for lone ones), and the columns as p_... and g_...  A pass
    matches equal keys of its list; null keys match nothing.  Keys and columns have one type on both sides.
    """
    columns = columns or []
    keys = list(dict.fromkeys(k for p in passes for k in p))
    shared = [k for k in keys if all(k in p for p in passes)]

    def side(df: DataFrame, true: bool) -> DataFrame:
        return df.select(*doc, *(F.col(k).alias(f"__k_{k}") for k in keys), F.lit(true).alias("__true"), F.col(order).alias("__ord"), F.struct(*(F.col(c).alias(c) for c in columns), F.col(order).alias("__o")).alias("__row"))

    place = [*doc, *(f"__k_{k}" for k in shared)]
    # Each pass sorts what a task has, so tasks are as many as partitions, not as few as their bytes would let them be.
    rows = spread(side(pred, False).unionByName(side(gold, True)), *place).withColumns({"__pass": F.lit(None).cast("int"), "__rank": F.lit(None).cast("int")})
    for number, names in enumerate(passes, 1):
        by = [*place, *(f"__k_{k}" for k in names if k not in shared)]
        rows = rows.withColumn("__open", F.col("__pass").isNull() & ~F.greatest(*(F.col(f"__k_{k}").isNull() for k in names), F.lit(False)))
        rank = F.row_number().over(Window.partitionBy(*by, "__open", "__true").orderBy("__ord"))
        rows = rows.withColumn("__r", rank)
        both = Window.partitionBy(*by)
        other = F.when(F.col("__true"), F.count_if(F.col("__open") & ~F.col("__true")).over(both)).otherwise(F.count_if(F.col("__open") & F.col("__true")).over(both))
        hit = F.col("__open") & (F.col("__r") <= F.col("__n"))
        rows = rows.withColumn("__n", other).withColumns({"__pass": F.when(hit, F.lit(number)).otherwise(F.col("__pass")), "__rank": F.when(hit, F.col("__r")).otherwise(F.col("__rank"))})
    lone = F.col("__pass").isNull()
    # A pair has the keys of its pass and a rank in common; a lone record is a group of its own.
    used = {k: F.when(F.col("__pass").isin([n for n, names in enumerate(passes, 1) if k in names]), F.col(f"__k_{k}")) for k in keys if k not in shared}
    group = rows.withColumns({f"__k_{k}": c for k, c in used.items()} | {"__alone": F.when(lone, F.col("__true")), "__at": F.when(lone, F.col("__ord"))})
    by = [*place, *(f"__k_{k}" for k in used), "__pass", "__rank", "__alone", "__at"]
    pairs = group.groupBy(*by).agg(F.first(F.when(~F.col("__true"), F.col("__row")), ignorenulls=True).alias("p"), F.first(F.when(F.col("__true"), F.col("__row")), ignorenulls=True).alias("g"))
    return pairs.select(*doc, F.col("p.__o").alias("p_ord"), F.col("g.__o").alias("g_ord"), F.col("__pass").alias("pass_no"), *(F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "pg" for c in columns))


def match_passes(pred: DataFrame, gold: DataFrame, doc: list[str], passes: list[list[str]], order: str = "ord") -> DataFrame:
    """Pairs (doc..., p_ord, g_ord, pass_no), one pass after the other over what earlier passes left."""
    return records(pred, gold, doc, passes, order=order).where("pass_no is not null")


def bag_counts(pred: DataFrame, gold: DataFrame, doc: list[str], passes: list[list[str]], correct: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Tp, fp and fn of each document.

    A matched pair counts as correct, or as one false positive and one false negative if
    `correct`, an expression over p_ and g_ columns, does not hold.
    """
    rows = records(pred, gold, doc, passes, columns)
    right = F.col("pass_no").isNotNull() & (F.lit(True) if correct is None else F.coalesce(correct, F.lit(False)))
    return rows.groupBy(*doc).agg(
        F.count_if(right).alias("tp"),
        F.count_if(~right & F.col("p_ord").isNotNull()).alias("fp"),
        F.count_if(~right & F.col("g_ord").isNotNull()).alias("fn"),
    )


def without_other(pred: DataFrame, gold: DataFrame, doc: list[str], value: str = "value", kind: str = "type") -> tuple[DataFrame, DataFrame]:
    """J01, result tables: truths of type Other leave, and so do predictions of that type or with the value of one."""
    other = gold.where(F.col(kind) == "Other").select(*doc, value).distinct()
    keep = lambda df: df.where(F.coalesce(F.col(kind) != "Other", F.lit(True)))
    return keep(pred).join(other, [*doc, value], "left_anti"), keep(gold)


def attribute_counts(pred: DataFrame, gold: DataFrame, doc: list[str], passes: list[list[str]], attributes: list[str]) -> DataFrame:
    """Tp, fp and fn over attributes; xx is an attribute that is not given."""
    rows = records(pred, gold, doc, passes, attributes)
    has = lambda c: F.coalesce(c, F.lit(strings.UNKNOWN)) != strings.UNKNOWN
    tp, fp, fn = F.lit(0), F.lit(0), F.lit(0)
    for a in attributes:
        p, g = F.col(f"p_{a}"), F.col(f"g_{a}")
        hit = has(p) & has(g) & F.coalesce(strings.attr_match(g, p), F.lit(False))
        tp += F.when(hit, 1).otherwise(0)
        fp += F.when(has(p) & ~hit, 1).otherwise(0)
        fn += F.when(has(g) & ~hit, 1).otherwise(0)
    return rows.groupBy(*doc).agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))


def index_counts(pred: DataFrame, gold: DataFrame, keys: list[str], attributes: list[str], doc: list[str]) -> DataFrame:
    """Attribute counts of records joined by a unique index; truths may be arrays of alternatives."""
    p = pred.select(*keys, *(F.col(a).alias(f"p_{a}") for a in attributes))
    g = gold.select(*keys, *(F.col(a).alias(f"g_{a}") for a in attributes))
    both = p.join(g, keys, "full_outer")
    tp, fp, fn = F.lit(0), F.lit(0), F.lit(0)
    for a in attributes:
        several = dict(gold.dtypes)[a].startswith("array")
        has_p = F.coalesce(F.col(f"p_{a}") != strings.UNKNOWN, F.lit(False))
        has_g = F.coalesce(F.size(F.col(f"g_{a}")) > 0 if several else F.col(f"g_{a}") != strings.UNKNOWN, F.lit(False))
        same = F.exists(F.col(f"g_{a}"), lambda x, a=a: strings.attr_match(x, F.col(f"p_{a}"))) if several else strings.attr_match(F.col(f"g_{a}"), F.col(f"p_{a}"))
        hit = has_p & has_g & F.coalesce(same, F.lit(False))
        tp += hit.cast("int")
        fp += (has_p & ~hit).cast("int")
        fn += (has_g & ~hit).cast("int")
    return both.groupBy(*doc).agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))


class _Open:
    """The truths of a group that are free, by value; the first in order within a tolerance is found in logarithmic time."""

    def __init__(self, values: list[float], tolerance: float, relative: bool):
        self.by_value = sorted(range(len(values)), key=values.__getitem__)
        self.values = [values[k] for k in self.by_value]
        self.tolerance, self.relative = tolerance, relative
        self.size = 1 << max(0, len(values) - 1).bit_length()
        # A tree of least places in order: leaf k is that of the k-th value, or past all if it is taken.
        self.none = len(values)
        self.tree = [self.none] * self.size + self.by_value + [self.none] * (self.size - len(values))
        for k in range(self.size - 1, 0, -1):
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])
        self.leaf = {place: k for k, place in enumerate(self.by_value)}

    def near(self, v: float, g: float) -> bool:
        return abs(v - g) / (max(abs(g), 1e-9) if self.relative else 1.0) < self.tolerance

    def take(self, v: float) -> int | None:
        """The place of the first free truth near a value, which is then taken."""
        middle = bisect.bisect_left(self.values, v)
        # Truths near v are a run around it: none between it and one that is near is not.
        lo = bisect.bisect_left(range(middle), True, key=lambda k: self.near(v, self.values[k]))
        hi = middle + bisect.bisect_left(range(middle, len(self.values)), True, key=lambda k: not self.near(v, self.values[k]))
        least, a, b = self.none, lo + self.size, hi + self.size
        while a < b:
            if a & 1:
                least, a = min(least, self.tree[a]), a + 1
            if b & 1:
                b -= 1
                least = min(least, self.tree[b])
            a, b = a >> 1, b >> 1
        if least == self.none:
            return None
        k = self.leaf[least] + self.size
        self.tree[k] = self.none
        while k > 1:
            k >>= 1
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])
        return least


def _cell(v: Column, tolerance: float, relative: bool) -> Column:
    """A whole number by which values that can match differ by 1 at most."""
    if not relative:
        return F.floor(v / tolerance)
    size = F.floor(F.ln(F.greatest(F.abs(v), F.lit(1e-9)) / 1e-9) / -math.log(1 - tolerance)) + 1
    return F.when(F.abs(v) <= 1e-9, F.lit(0)).otherwise(F.signum(v) * size).cast("long")


def tolerance_match(pred: DataFrame, gold: DataFrame, keys: list[str], value: str = "value", tolerance: float = 0.01, relative: bool = False, order: str = "ord", hot: int = 1 << 16) -> DataFrame:
    """Greedy pairs (keys..., p_ord, g_ord) of values closer than a tolerance, in order, inside equal keys.

    Each prediction in order takes the first truth in order that is free and near it.  relative: the difference is divided by the
    truth, and the tolerance is below 1.  Rows whose value or one of whose keys is null, or whose value is no finite number, are left out.  Orders of one
    key and side tell rows apart.

    Rows stream through tasks sorted by key, truths first; of a key the truths are held in a tree, so n rows take n log n
    steps.  A key of more than `hot` rows is cut where no value lies within the tolerance: values are put into cells of its width, and a
    run of cells without an empty one between has nothing to do with others.
    """
    if relative and not 0 < tolerance < 1:
        raise ValueError("a relative tolerance is between 0 and 1")
    side = lambda df, true: df.select(*keys, F.col(value).cast("double").alias("__v"), F.col(order).cast("long").alias("__o"), F.lit(true).alias("__true"))
    rows = side(pred, False).unionByName(side(gold, True)).dropna(subset=["__v", *keys]).where(F.abs("__v") < float("inf")).withColumn("__run", F.lit(0).cast("long"))
    crowded = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot).drop("__n")
    if not crowded.isEmpty():
        much = rows.join(crowded, keys, "left_semi").withColumn("__cell", _cell(F.col("__v"), tolerance, relative))
        cells = much.select(*keys, "__cell").distinct()
        before = cells.select(*keys, (F.col("__cell") + 1).alias("__cell"), F.lit(True).alias("__goes_on"))
        starts = cells.join(before, [*keys, "__cell"], "left").withColumn("__start", F.when(F.col("__goes_on").isNull(), F.col("__cell"))).drop("__goes_on")
        runs = ranks.fill_down(starts, [*keys, "__cell"], "__start", "__r").select(*keys, "__cell", F.col("__r").cast("long").alias("__r"))
        much = much.join(runs, [*keys, "__cell"]).select(*keys, "__v", "__o", "__true", F.col("__r").alias("__run"))
        rows = rows.join(crowded, keys, "left_anti").unionByName(much)
    schema = StructType([*(rows.schema[k] for k in keys), StructField("p_ord", LongType()), StructField("g_ord", LongType())])

    def paired(batches):
        now, truths, orders, free = None, [], [], None
        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            at, p_ord, g_ord = [], [], []
            for k, (*key, v, o, true) in enumerate(zip(*lists, strict=True)):
                if key != now:
                    now, truths, orders, free = key, [], [], None
                if true:
                    truths.append(v)
                    orders.append(o)
                elif truths:
                    free = free or _Open(truths, tolerance, relative)
                    if (place := free.take(v)) is not None:
                        at.append(k)
                        p_ord.append(o)
                        g_ord.append(orders[place])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), pa.array(p_ord, pa.int64()), pa.array(g_ord, pa.int64())], schema.names)

    sorted_rows = rows.repartition(*keys, "__run").sortWithinPartitions(*keys, "__run", F.desc("__true"), "__o").select(*keys, "__run", "__v", "__o", "__true")
    return sorted_rows.mapInArrow(paired, schema)


def max_weight_pairs(weights: list[list[float]], least: float = 0.25) -> list[tuple[int, int]]:
    """A matching of rows and columns with as many edges (weights above `least`) as can be, of those one with the most weight."""
    n, m = len(weights), len(weights[0]) if weights else 0
    if not n or not m:
        return []
    size = max(n, m)
    big = 1.0 + size * max(1.0, max(map(max, weights)))
    cost = [[-(big + weights[i][j]) if i < n and j < m and weights[i][j] > least else 0.0 for j in range(size)] for i in range(size)]
    # Shortest augmenting paths with potentials, a row at a time.
    u, v, owner = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1)
    for row in range(1, size + 1):
        owner[0], j0 = row, 0
        best, way, used = [float("inf")] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        while True:
            used[j0], i0, delta, j1 = True, owner[j0], float("inf"), 0
            for j in range(1, size + 1):
                if not used[j]:
                    now = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < best[j]:
                        best[j], way[j] = now, j0
                    if best[j] < delta:
                        delta, j1 = best[j], j
            for j in range(size + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    best[j] -= delta
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return sorted((owner[j] - 1, j - 1) for j in range(1, size + 1) if owner[j] <= n and j <= m and weights[owner[j] - 1][j - 1] > least)


def first_fit(candidates: DataFrame, doc: list[str], order: list, left: str, right: str) -> DataFrame:
    """Of candidate pairs, document by document in an order, those whose both ends no earlier one has taken.

    Rows stream through a task sorted; what is held are the taken ends of one document.
    """

    def taken(batches):
        now, used_left, used_right = None, set(), set()
        for batch in batches:
            keep = []
            for *at, a, b in zip(*(batch[c] for c in [*doc, left, right]), strict=True):
                if at != now:
                    now, used_left, used_right = at, set(), set()
                fits = a not in used_left and b not in used_right
                if fits:
                    used_left.add(a)
                    used_right.add(b)
                keep.append(fits)
            yield batch[keep]

    return candidates.repartition(*doc).sortWithinPartitions(*doc, *order).mapInPandas(taken, candidates.schema)


PREFIX_SEPARATORS = "-.@_ #"


def name_match(pred: DataFrame, gold: DataFrame, doc: list[str], name: str = "name") -> DataFrame:
    """One-to-one pairs (doc..., g_name, p_name, phase) of distinct sample names.

    Phase 1 is equality, 2 equality after normalising dashes and blanks, 3 a prefix of the
    other followed by a separator.  Phase 3 goes in sorted order of names, so that ties
    are settled alike everywhere; forward (the prediction is longer) comes first.  Its
    candidates come from a join on the prefixes that end before a separator.
    """
    side = lambda df: df.select(*doc, F.col(name).alias("own")).dropna().distinct().withColumn("norm", strings.sample_name(F.col("own"))).select(*doc, "own", "norm", F.struct("norm", "own").alias("at"))
    found = settle(records(side(pred), side(gold), doc, [["own"], ["norm"]], ["own", "norm"], order="at"))  # read for the pairs, and for what is left of either side twice
    pairs = found.where("pass_no is not null").select(*doc, F.col("g_own").alias("g_name"), F.col("p_own").alias("p_name"), F.col("pass_no").alias("phase"))
    left = lambda x: found.where(f"pass_no is null and {x}_own is not null").select(*doc, F.col(f"{x}_own").alias(f"{x}_name"), F.col(f"{x}_norm").alias(f"{x}_norm"))
    ends = lambda c: F.filter(F.sequence(F.lit(1), F.length(c)), lambda k: F.contains(F.lit(PREFIX_SEPARATORS), F.substr(c, k + 1, F.lit(1))) & (k < F.length(c)))
    prefixed = lambda x, other: left(x).withColumn(f"{other}_norm", F.explode(F.transform(ends(F.col(f"{x}_norm")), lambda k: F.left(F.col(f"{x}_norm"), k))))
    longer = prefixed("p", "g").join(left("g"), [*doc, "g_norm"]).withColumn("back", F.lit(False))
    shorter = prefixed("g", "p").join(left("p"), [*doc, "p_norm"]).withColumn("back", F.lit(True))
    candidates = longer.unionByName(shorter).select(*doc, "g_norm", "g_name", "back", "p_norm", "p_name")

    third = first_fit(candidates, doc, ["g_norm", "g_name", "back", "p_norm", "p_name"], "g_name", "p_name")
    return pairs.unionByName(third.select(*doc, "g_name", "p_name", F.lit(3).alias("phase")))


def best_offset(pred: DataFrame, gold: DataFrame, doc: list[str], index: str, element: str, value: str, offsets: int = 10, tolerance: float = 0.1) -> DataFrame:
    """(doc..., shift, agreeing): the shift of positions, of 0 to offsets - 1, under which most element values agree within a tolerance; the least of equals."""
    g = gold.select(*doc, F.col(index).alias("i"), element, F.col(value).alias("g"))
    p = pred.select(*doc, F.explode(F.sequence(F.lit(0), F.lit(offsets - 1))).alias("shift"), (F.col(index)).alias("j"), element, F.col(value).alias("p")).withColumn("i", F.col("j") - F.col("shift"))
    close = F.abs(F.col("p") - F.col("g")) <= tolerance * F.abs(F.col("g"))
    scored = g.join(p, [*doc, "i", element]).groupBy(*doc, "shift").agg(F.count_if(close).alias("agreeing"))
    return scored.groupBy(*doc).agg(F.max(F.struct("agreeing", (-F.col("shift")).alias("n"))).alias("b")).select(*doc, (-F.col("b.n")).alias("shift"), F.col("b.agreeing").alias("agreeing"))


def position_pairs(pred: DataFrame, gold: DataFrame, doc: list[str], index: str, element: str, value: str, offsets: int = 10, tolerance: float = 0.1, least: float = 0.3, over: int = 3) -> DataFrame:
    """(doc..., g_index, p_index, score): rows aligned by position, and how large a share of their common elements agrees.

    pred and gold: doc..., index (the row's number in the document), element (once a row),
    value; only values above 0 are compared, but all rows count.  The shift of a document (0
    to offsets - 1) is that of the largest total score, the least of equals; its pairs are
    those with a score of `least` or more.  Where a document has more than `over` times as
    many predicted rows as true ones, each true row in order takes the unused prediction of
    the highest score above `least`, the first of equals.
    """
    number = F.col(value).cast("double")
    side = lambda df, true: df.select(*doc, F.col(index).cast("long").alias("__at"), F.col(element).alias("element"), number.alias("__v"), F.lit(true).alias("__true"))
    # Both sides meet in one shuffle; documents are told apart and aligned where their rows lie.
    rows = spread(side(pred, False).unionByName(side(gold, True)), *doc, rows=pred.count() + gold.count())
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy(*doc, "__true", "__at").orderBy("element")) == 1)
    n = lambda true: F.count_if(F.col("first") & F.col("__at").isNotNull() & (F.col("__true") == true)).over(Window.partitionBy(*doc))
    rows = rows.withColumn("large", n(False) > over * n(True)).where("__v > 0 and not isnan(__v) and __at is not null and element is not null").dropna(subset=doc)
    close = F.abs(F.col("p") - F.col("g")) / F.col("g") < tolerance

    reach = Window.partitionBy(*doc, "element").orderBy("__at").rangeBetween(0, offsets - 1)
    met = rows.where("not large").withColumn("met", F.collect_list(F.when(~F.col("__true"), F.struct(F.col("__at").alias("p_index"), F.col("__v").alias("p")))).over(reach)).where("__true")
    pairs = met.select(*doc, F.col("__at").alias("g_index"), F.col("__v").alias("g"), F.inline("met"))
    scored = pairs.groupBy(*doc, "g_index", "p_index").agg((F.count_if(close) / F.count("*")).alias("score")).withColumn("shift", F.col("p_index") - F.col("g_index"))
    total = F.round(F.sum("score").over(Window.partitionBy(*doc, "shift")), 9)
    best = -F.max(F.struct("total", (-F.col("shift")).alias("n"))).over(Window.partitionBy(*doc))["n"]
    aligned = scored.withColumn("total", total).withColumn("best", best).where((F.col("shift") == F.col("best")) & (F.col("score") >= least)).select(*doc, "g_index", "p_index", "score")

    # Values that agree are in the same class of sizes or in neighbouring ones.
    size = lambda c: F.floor(F.ln(c) / -math.log(1 - tolerance)).cast("long")
    own = settle(rows.where("large"))
    large = lambda true, i, v: own.where(F.col("__true") == true).select(*doc, F.col("__at").alias(i), "element", F.col("__v").alias(v))
    lg, lp = large(True, "g_index", "g"), large(False, "p_index", "p")
    near = lg.withColumn("size", F.explode(F.sequence(size("g") - 1, size("g") + 1))).join(lp.withColumn("size", size("p")), [*doc, "element", "size"]).where(close)
    elements = lambda df, i, c: df.groupBy(*doc, i).agg(F.collect_set("element").alias(c))
    both = near.groupBy(*doc, "g_index", "p_index").agg(F.count("*").alias("n"))
    both = both.join(elements(lg, "g_index", "g_e"), [*doc, "g_index"]).join(elements(lp, "p_index", "p_e"), [*doc, "p_index"])
    candidates = both.select(*doc, "g_index", "p_index", (F.col("n") / F.size(F.array_intersect("g_e", "p_e"))).alias("score")).where(F.col("score") > least)

    taken = first_fit(candidates, doc, ["g_index", F.desc("score"), "p_index"], "g_index", "p_index")
    return aligned.unionByName(taken)


def gap_fill(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; values of the first win, its nulls are filled from the second."""
    columns = [c for c in first.columns if c not in keys]
    a = first.select(*keys, *(F.col(c).alias(f"__a_{c}") for c in columns))
    b = second.select(*keys, *(F.col(c).alias(f"__b_{c}") for c in columns))
    return a.join(b, keys, "full_outer").select(*keys, *(F.coalesce(f"__a_{c}", f"__b_{c}").alias(c) for c in columns))


def append_new(base: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Base, and those rows of more whose keys (not null) base does not have."""
    return base.unionByName(more.dropna(subset=keys).join(base.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def row_by_name(names: DataFrame, rows: DataFrame, doc: list[str], name: str, columns: list[str], order: str = "ord") -> DataFrame:
    """For each name the rows that have it in the first id column (in the given order) where any has, merged by first non-null."""
    from tablewright.operators.consensus import first_non_null

    tall = rows.select(*doc, F.col(order), F.posexplode(F.array(*columns)).alias("priority", name), *[c for c in rows.columns if c not in [*doc, order, *columns]])
    hits = names.join(tall, [*doc, name])
    least = hits.withColumn("least", F.min("priority").over(Window.partitionBy(*doc, name))).where("priority = least").drop("least", "priority")
    return first_non_null(least, [*doc, name], order)


def error_classes(pred: DataFrame, gold: DataFrame, doc: list[str], near: bool = True) -> DataFrame:
    """Counts (class, n) of attribute errors, near misses (under 5 percent off), surplus and missed records.

    pred and gold: doc..., ord, value, type, unit.  Values are matched by their cores, types and units compared after H02.
    """
    cored = lambda df: df.withColumns({"__core": strings.normalize_text(strings.value_core(F.col("value"))), "type": F.col("type").cast("string"), "unit": F.col("unit").cast("string")})
    rows = records(cored(pred), cored(gold), doc, [["__core"]], ["value", "type", "unit"])
    if near:
        rows = settle(rows)  # read for each class, and by the match within the tolerance
    same = lambda c: F.coalesce(strings.normalize_text(F.col(f"p_{c}")), F.lit("")) == F.coalesce(strings.normalize_text(F.col(f"g_{c}")), F.lit(""))
    wrong = F.when(F.col("pass_no").isNotNull() & ~(same("type") & same("unit")), "VAL_MATCH_ATTR_WRONG")
    lone = [F.when(F.col("g_ord").isNull(), "OVER_EXTRACT"), F.when(F.col("p_ord").isNull(), "MISSED")]
    # One scan of the records, since each branch of a union would match them anew.
    out = rows.select(F.explode(F.array_compact(F.array(wrong, *([] if near else lone)))).alias("class"))
    number = lambda c: F.regexp_extract(c.cast("string"), r"([-+]?\d*\.?\d+)", 1).try_cast("double")
    lone_p = rows.where("g_ord is null").select(*doc, F.col("p_ord").alias("ord"), number(F.col("p_value")).alias("value"))
    lone_g = rows.where("p_ord is null").select(*doc, F.col("g_ord").alias("ord"), number(F.col("g_value")).alias("value"))
    if near:
        close = tolerance_match(lone_p, lone_g, doc, tolerance=0.05, relative=True)
        lone_p = lone_p.join(close.select(*doc, F.col("p_ord").alias("ord")), [*doc, "ord"], "left_anti")
        lone_g = lone_g.join(close.select(*doc, F.col("g_ord").alias("ord")), [*doc, "ord"], "left_anti")
        out = out.union(close.select(F.lit("NEAR_MISS"))).union(lone_p.select(F.lit("OVER_EXTRACT"))).union(lone_g.select(F.lit("MISSED")))
    missing = F.coalesce(F.col("value").cast("string"), F.lit("")) == ""
    schema_errors = pred.where(missing | (F.coalesce(F.col("type").cast("string"), F.lit("")) == "")).select(F.lit("SCHEMA_ERR"))
    return out.union(schema_errors).groupBy("class").agg(F.count("*").alias("n"))


def closest_text(nodes: DataFrame, wanted: DataFrame, page: list[str], levels: tuple[float, ...] = (0.8, 0.5, 0.25)) -> DataFrame:
    """For each wanted value (page..., attribute, value) the page's node text (node_ord, node_text) with the highest word F1, the first in text order of equals, or <NULL> (f1 null) below the last level.

    A page of few wanted values is compared as a whole, one of many by an index search that goes down the levels (similarity.closest).
    """
    found = similarity.closest(wanted.select(*page, "value"), nodes.select(*page, F.col("node_text").alias("value"), "node_ord"), page, "value", "node_ord", levels)
    return wanted.select(*page, "attribute", "value").join(found, [*page, "value"], "left").select(*page, "attribute", "value", F.coalesce("node_text", F.lit("<NULL>")).alias("node_text"), "f1")


#: Pairs of a label and a name that are sent to all tasks.
FEW_PAIRS = 1 << 16


def material_of(cells: DataFrame, names: DataFrame, table: list[str]) -> DataFrame:
    """For each value cell (row, col) the label cell above or left of it that best contains a known name or is contained in one.

    cells: table..., row, col, raw, one a place; names: table..., material.  Best is the larger ratio of
    lengths, then the smaller column, then the smaller row.  Which label holds which name is found by two scans of the distinct texts
    (found_names); the best label before a cell is a running maximum down its column and along its row.
    """
    own = names.select(*table, F.lower(F.trim("material")).alias("material")).where("material <> ''").dropna(subset=table)
    marked = cells.select(*table, "row", "col", F.lower(F.trim("raw")).alias("label"), F.col("raw").rlike(r"^\s*[<>]?\s*[-+]?\d").alias("is_value"))
    labels, materials = settle(marked.select("label").where("label <> ''").distinct()), settle(own.select("material").distinct())
    inside = dictionary.found_names(labels, ["label"], "label", materials, "material").withColumnRenamed("name", "material")
    around = dictionary.found_names(materials, ["material"], "material", labels, "label").withColumnRenamed("name", "label")
    ratio = F.least(F.length("label"), F.length("material")) / F.greatest(F.length("label"), F.length("material"))
    pairs = settle(inside.unionByName(around).distinct().withColumn("ratio", ratio))
    # Few pairs go to all tasks, so no cell is shuffled by its text.
    pairs = F.broadcast(pairs) if pairs.count() <= FEW_PAIRS else pairs
    # Cells and names of a table meet in one shuffle.
    met = marked.join(pairs, "label", "left").drop("label").unionByName(own.withColumn("__own", F.lit(True)), allowMissingColumns=True)
    met = spread(met, *table, rows=cells.count())
    known = F.max("__own").over(Window.partitionBy(*table, "material"))
    # By ratio, then the smaller column and row, then the name.
    rank = F.when(known & F.col("material").isNotNull(), F.struct("ratio", (-F.col("col")).alias("c"), (-F.col("row")).alias("r"), "material"))
    placed = met.withColumn("rank", rank).where("__own is null").groupBy(*table, "row", "col").agg(F.max("rank").alias("rank"), F.max("is_value").alias("is_value"))
    before = lambda line, along: F.max("rank").over(Window.partitionBy(*table, line).orderBy(along).rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumns({"above": before("col", "row"), "left": before("row", "col")})
    return placed.where("is_value").withColumn("best", F.greatest("above", "left")).where("best is not null").select(*table, "row", "col", F.col("best.material").alias("material"))


def tuple_counts(pred: DataFrame, gold: DataFrame, keys: list[str], doc: list[str]) -> DataFrame:
    """Tp, fp, fn by membership: each prediction that is among the truths counts, so repeated ones count each."""
    p, g = pred.select(*keys), gold.select(*keys)
    hit = p.join(g.distinct(), keys, "left_semi").groupBy(*doc).agg(F.count("*").alias("tp"))
    n_p, n_g = p.groupBy(*doc).agg(F.count("*").alias("n_p")), g.groupBy(*doc).agg(F.count("*").alias("n_g"))
    found = g.join(p.distinct(), keys, "left_semi").groupBy(*doc).agg(F.count("*").alias("found"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = n_p.join(n_g, doc, "full_outer").join(hit, doc, "left").join(found, doc, "left")
    return both.select(*doc, zero("tp").alias("tp"), (zero("n_p") - zero("tp")).alias("fp"), (zero("n_g") - zero("found")).alias("fn"))
