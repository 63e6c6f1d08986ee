"""Partitions: stratified item-level and group-level splits, folds, weights and draws, in md5 order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .leakage import manifest_join
from .ranking import numbered

SPLITS = ("train", "val", "test")


def shuffled(seed: Column | int, *parts: Column) -> Column:
    """A sort key that depends on seed and parts only."""
    first = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat_ws("|", first, *(p.cast("string") for p in parts)).cast("binary"))


def with_seeds(df: DataFrame, seeds: list[int]) -> DataFrame:
    return df.withColumn("seed", F.explode(F.array(*(F.lit(s) for s in seeds))))


def cut(rank: Column, n: Column, train: float = 0.8, val: float = 0.1) -> Column:
    """Split by rank from 1: shares of train and val are rounded half to even, the rest is test."""
    a = F.bround(n * F.lit(train))
    b = F.bround(n * F.lit(val))
    return F.when(rank <= a, "train").when(rank <= a + b, "val").otherwise("test")


def stratified_split(df: DataFrame, cls: str, key: str, seeds: list[int] | None = None, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Adds split (and seed, if seeds are given): each class is shuffled and cut."""
    by = [cls] if seeds is None else ["seed", cls]
    base = df if seeds is None else with_seeds(df, seeds)
    order = shuffled(0 if seeds is None else F.col("seed"), F.col(cls), F.col(key))
    ranked = numbered(base, by, order, [key], even=True)
    return ranked.withColumn("split", cut(F.col("__r"), F.col("__n"), train, val)).drop("__r", "__n")


def _filled(wanting: list[float], size: int, many: int) -> list[int]:
    """How many of many groups of one size each place gets, each group going where most is wanting (ties: the first)."""
    left, got = list(wanting), [0] * len(wanting)
    if many > 64:
        # All places end near one level: whole steps down to it are taken at once, the few that are left one by one.
        lo, hi = min(left) - size * many, max(left)
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(max(0, int((x - mid) // size)) for x in left) > many else (lo, mid)
        got = [max(0, int((x - hi) // size)) for x in left]
        left = [x - k * size for x, k in zip(left, got, strict=True)]
    for _ in range(many - sum(got)):
        at = max(range(len(left)), key=lambda i: (left[i], -i))
        got[at] += 1
        left[at] -= size
    return got


def _ranges(counts: list[int]) -> list[tuple[int, int]]:
    ends = [sum(counts[: i + 1]) for i in range(len(counts))]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def grouped_split(df: DataFrame, cls: str, group: str, seed: int = 0, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Adds split: whole groups are placed, the largest first, where most items are wanting.

    A class with three groups or more has an item in each split, if need be the last one of train's. Groups of one
    size are alike but for their names: one task takes a class's distinct sizes with their numbers, a short table
    however many groups there are, and groups of a size are dealt in shuffled order.
    """
    import pandas as pd

    groups = df.groupBy(F.col(cls).alias("__c"), F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__size"))
    sizes = groups.groupBy("__c", "__size").agg(F.count(F.lit(1)).alias("m"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__size", ascending=False).reset_index(drop=True)
        total = int((pdf["__size"] * pdf.m).sum())
        left = [total * train, total * val, total * (1 - train - val)]
        got = []
        for size, m in zip(pdf["__size"], pdf.m, strict=True):
            counts = _filled(left, int(size), int(m))
            left = [x - k * int(size) for x, k in zip(left, counts, strict=True)]
            got.append(counts)
        if pdf.m.sum() >= 3:
            for want in (2, 1):
                donors = [i for i, counts in enumerate(got) if counts[0]]
                if not any(counts[want] for counts in got) and donors:
                    got[donors[-1]][0] -= 1
                    got[donors[-1]][want] += 1
        rows = [(c, n, s, lo, hi) for c, n, counts in zip(pdf["__c"], pdf["__size"], got, strict=True) for s, (lo, hi) in zip(SPLITS, _ranges(counts), strict=True) if hi > lo]
        return pd.DataFrame(rows, columns=["c", "n", "split", "lo", "hi"])

    placed = sizes.groupBy("__c").applyInPandas(place, f"c {dict(groups.dtypes)['__c']}, n long, split string, lo long, hi long")
    ranked = numbered(groups, ["__c", "__size"], shuffled(seed, F.col("__c"), F.col("__g")), ["__g"], count=None, even=True)
    told = ranked.join(placed, ranked["__c"].eqNullSafe(placed["c"]) & (F.col("__size") == F.col("n")) & (F.col("__r") > F.col("lo")) & (F.col("__r") <= F.col("hi"))).select("__c", "__g", "split")
    return df.join(told, df[cls].eqNullSafe(told["__c"]) & df[group].eqNullSafe(told["__g"]), "left").select(df["*"], told["split"])


def usable_folds(df: DataFrame, cls: str, group: str, k: int = 5) -> DataFrame:
    """max(2, min(k, the least number of groups in a class))."""
    least = df.groupBy(cls).agg(F.countDistinct(group).alias("n")).agg(F.min("n").alias("least_groups"))
    return least.select("least_groups", F.greatest(F.lit(2), F.least(F.lit(k).cast("long"), F.col("least_groups"))).cast("long").alias("usable_k"))


def item_folds(df: DataFrame, cls: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """Adds fold: items of each class are dealt in shuffled order."""
    ranked = numbered(df, [cls], shuffled(seed, F.col(cls), F.col(key)), [key], count=None, even=True)
    return ranked.withColumn("fold", F.pmod(F.col("__r") - 1, F.lit(k)).cast("long")).drop("__r")


def dealt_evenly(load: np.ndarray, counts: np.ndarray, many: int, whole: np.ndarray) -> np.ndarray:
    """How many of many groups with the same class counts each fold gets, one after the other, each going where class
    counts then vary least over folds (ties: the least items, the first fold). load: the folds' counts, which are changed.

    Where a group goes depends on the differences of loads alone. Runs that go to one fold are looked through in blocks,
    and once the differences are as they were before, whole periods are taken at once: both exactly as one by one.
    """
    k, classes = load.shape
    got, left = np.zeros(k, np.int64), int(many)
    where = np.arange(k)

    def best(states: np.ndarray) -> np.ndarray:
        """The fold of the next group, for each state of loads."""
        tries = states[:, None] + np.eye(k)[:, :, None] * counts
        tries -= states.min(1)[:, None, None]
        spread, total = (tries / whole).std(2).mean(2), tries[:, where, where].sum(2)
        return np.where(spread == spread.min(1)[:, None], total, np.inf).argmin(1)

    turn, limit, ahead = 0, 1, 1
    known, known_got, known_left = (load - load.min(0)).tobytes(), got.copy(), left
    while left:
        fold, run = int(best(load[None])[0]), 1
        block = min(ahead, left - 1, max(1, (1 << 20) // (k * k * classes)))
        if block:
            after = np.repeat(load[None], block, 0)
            after[:, fold] += np.arange(1, block + 1)[:, None] * counts
            same = best(after) == fold
            run += block if same.all() else int(same.argmin())
            ahead = ahead * 2 if run > block else 1
        load[fold] += counts * run
        got[fold] += run
        left -= run
        turn += 1
        state = (load - load.min(0)).tobytes()
        if state == known and left:
            period, step = known_left - left, got - known_got
            times = left // period
            load += counts * (step * times)[:, None]
            got += step * times
            left -= period * times
            known_got, known_left = got.copy(), left
        elif turn == limit:  # Brent: the state kept moves on at powers of two
            known, known_got, known_left, turn, limit = state, got.copy(), left, 0, limit * 2
    return got


def group_folds(df: DataFrame, cls: str, group: str, k: int, seed: int = 0) -> DataFrame:
    """Adds fold: whole groups, the most uneven first, go where class counts then vary least over folds.

    Groups with the same counts of classes are alike but for their names: one task takes the distinct lists of counts
    with their numbers (see dealt_evenly), and groups of a list are dealt in shuffled order.
    """
    import pandas as pd

    counts = df.groupBy(F.col(group).alias("__g"), F.col(cls).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    # A group's list is as long as the number of classes at most.
    groups = counts.groupBy("__g").agg(F.to_json(F.array_sort(F.collect_list(F.struct("c", "n")))).alias("__list"))
    lists = groups.groupBy("__list").agg(F.count(F.lit(1)).alias("m")).withColumn("one", F.lit(1))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        pdf = pdf.sort_values("__list").reset_index(drop=True)
        found = [{x.get("c"): x["n"] for x in json.loads(v)} for v in pdf["__list"]]
        names = {c: i for i, c in enumerate(sorted({c for f in found for c in f}, key=str))}
        table = np.zeros((len(found), len(names)))
        for row, f in zip(table, found, strict=True):
            for c, n in f.items():
                row[names[c]] = n
        many = pdf.m.to_numpy()
        whole = np.maximum((table * many[:, None]).sum(0), 1)
        load, rows = np.zeros((k, len(names))), []
        for i in np.argsort(-table.std(1), kind="stable"):
            got = dealt_evenly(load, table[i], int(many[i]), whole).tolist()
            rows += [(pdf["__list"][i], f, lo, hi) for f, (lo, hi) in enumerate(_ranges(got)) if hi > lo]
        return pd.DataFrame(rows, columns=["list", "fold", "lo", "hi"])

    dealt = lists.groupBy("one").applyInPandas(deal, "list string, fold long, lo long, hi long")
    ranked = numbered(groups, ["__list"], shuffled(seed, F.col("__g")), ["__g"], count=None, even=True)
    told = ranked.join(dealt, (F.col("__list") == F.col("list")) & (F.col("__r") > F.col("lo")) & (F.col("__r") <= F.col("hi"))).select("__g", "fold")
    return df.join(told, df[group].eqNullSafe(told["__g"]), "left").select(df["*"], told["fold"])


def folds(df: DataFrame, mode: str, cls: str, key: str, group: str, k: int, seed: int = 0) -> DataFrame:
    if mode not in ("group", "image"):
        raise ValueError("mode is group or image")
    return group_folds(df, cls, group, k, seed) if mode == "group" else item_folds(df, cls, key, k, seed)


def inner_validation(df: DataFrame, fold: int, unit: str, share: float = 0.15, seed: int = 0) -> DataFrame:
    """Adds part for one fold: test, or of the rest val for max(1, round(share * units)) units, or train.

    With one unit left there is no validation part.
    """
    rest = df.where(F.col("fold") != fold).select(F.col(unit).alias("unit")).distinct()
    ranked = numbered(rest, [], shuffled(seed, F.col("unit")), even=True)
    val = ranked.where((F.col("__n") > 1) & (F.col("__r") <= F.greatest(F.lit(1), F.bround(F.col("__n") * share)))).select("unit", F.lit(True).alias("__val"))
    joined = df.join(val, df[unit] == val["unit"], "left")
    part = F.when(F.col("fold") == fold, "test").when(F.col("__val"), "val").otherwise("train")
    return joined.withColumn("part", part).drop("unit", "__val")


def fold_composition(df: DataFrame, cls: str, group: str) -> DataFrame:
    """fold, part, n_items, n_groups, n_missing: every fold as test against the others as train.

    Train's numbers are the whole table's without what stands in the fold alone, so that no row is repeated.
    """

    def seen(column: str, name: str) -> DataFrame:
        """fold, and how many values stand in it, and in no other."""
        of = df.where(F.col(column).isNotNull()).select("fold", F.col(column).alias("x")).distinct()
        alone = of.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("fold").alias("fold")).withColumn("only", (F.col("n") == 1).cast("long"))
        return of.groupBy("fold").agg(F.count(F.lit(1)).alias(f"{name}_in")).join(alone.groupBy("fold").agg(F.sum("only").alias(f"{name}_only")), "fold", "left")

    items = df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    whole = df.agg(F.count(F.lit(1)).alias("n_all"), F.countDistinct(group).alias("g_all"), F.countDistinct(cls).alias("c_all"))
    per = items.join(seen(group, "g"), "fold", "left").join(seen(cls, "c"), "fold", "left").crossJoin(F.broadcast(whole)).na.fill(0, ["g_in", "g_only", "c_in", "c_only"])
    test = F.struct(F.lit("test").alias("part"), F.col("n").alias("n_items"), F.col("g_in").alias("n_groups"), (F.col("c_all") - F.col("c_in")).alias("n_missing"))
    train = F.struct(F.lit("train").alias("part"), (F.col("n_all") - F.col("n")).alias("n_items"), (F.col("g_all") - F.col("g_only")).alias("n_groups"), F.col("c_only").alias("n_missing"))
    return per.select("fold", F.inline(F.array(test, train))).where("n_items > 0")


def missing_in_folds(df: DataFrame, cls: str) -> DataFrame:
    """fold, cls: the classes that a fold has no item of."""
    there = df.where(F.col(cls).isNotNull()).select("fold", F.col(cls).alias("cls")).distinct()
    folds_of = there.select("fold").distinct().agg(F.collect_list("fold").alias("folds"))  # k of them
    return there.select("cls").distinct().crossJoin(F.broadcast(folds_of)).select(F.explode("folds").alias("fold"), "cls").join(there, ["fold", "cls"], "left_anti")


def cv_index(items: DataFrame, manifest: DataFrame, classes: list[str], on: list[str], cls: str = "cls") -> DataFrame:
    """Items of all splits together, for cross-validation: those of the listed classes, with label (the class's place
    in the list) and session (unmapped:... for items that the manifest lacks)."""
    place = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col(cls)) - 1
    return manifest_join(items.where(F.col(cls).isin(*classes)), manifest, on).withColumn("label", place.cast("long"))


def few_shot(df: DataFrame, key: str, cls: str, n: int, seed: int = 0) -> DataFrame:
    """n items in shuffled order; none if a class would be missing."""
    drawn = df.orderBy(shuffled(seed, F.col(key)), key).limit(n)
    whole = df.select(cls).distinct().count() == drawn.select(cls).distinct().count()
    return drawn if whole else drawn.limit(0)


def class_weights(df: DataFrame, cls: str) -> DataFrame:
    """cls, n, weight = N / (K * n)."""
    per = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    whole = per.agg(F.sum("n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    return per.crossJoin(F.broadcast(whole)).select(cls, "n", (F.col("__all") / (F.col("__k") * F.col("n"))).alias("weight"))


def item_weights(df: DataFrame, cls: str) -> DataFrame:
    """The items with the weight of their class, for draws that balance classes."""
    per = class_weights(df, cls).select(F.col(cls).alias("__cls"), "weight")
    return df.join(per, df[cls].eqNullSafe(per["__cls"])).select(df["*"], "weight")


def label_ids(df: DataFrame, label: str) -> DataFrame:
    """label, id: dense numbers in label order."""
    labels = df.select(label).distinct()
    return labels.withColumn("id", (F.dense_rank().over(Window.orderBy(label)) - 1).cast("long"))


def verified(df: DataFrame, split: str, expected: dict[str, int]) -> DataFrame:
    """The table, if its splits have exactly the expected numbers of items."""
    got = {r[0]: r[1] for r in df.groupBy(split).count().collect()}
    if got != expected:
        raise ValueError(f"splits have {got}, expected {expected}")
    return df
