"""Preprocessing: fit once, apply and invert as projections.

A fit is one parameter table (stage, col, key, ord, num, str), small as the schema and its
categories.  It is collected once and compiled into expressions, so applying and inverting run no job.
Columns of more than ``large`` categories are an exception: their categories stay a table (see
``domains``), are numbered there, and are encoded and decoded by joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .domains import dictionary, kept_table, looked_up
from .profile import frequencies, long_numbers, number
from .running import exact_quantiles

PARAMS = "stage string, col string, key string, ord int, num double, str string"
SCALERS = ("minmax", "log1p", "standard")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


@dataclass
class Preprocessor:
    """Impute, encode and scale a table.

    ``numeric``: mean, median or mode; ``fill``: mode or constant for categories; ``encoding``:
    onehot, label or auto (one-hot up to ``cap`` categories); ``scaling``: minmax, log1p or standard.
    Per-column overrides go into ``numeric_by``, ``encoding_by`` and ``scaling_by``.
    """

    continuous: list[str]
    categorical: list[str]
    pii: list[str] = field(default_factory=list)
    numeric: str = "median"
    fill: str = "mode"
    encoding: str = "auto"
    scaling: str = "minmax"
    cap: int = 10
    low: float = 0.0
    high: float = 1.0
    scale_labels: bool = True
    unknown: str = "ignore"
    exact: bool = True
    large: int = 10_000
    numeric_by: dict[str, str] = field(default_factory=dict)
    encoding_by: dict[str, str] = field(default_factory=dict)
    scaling_by: dict[str, str] = field(default_factory=dict)
    params: list[Row] = field(default_factory=list)
    entries: DataFrame | None = None

    def __post_init__(self):
        for given, allowed in (
            ([self.numeric, *self.numeric_by.values()], ("mean", "median", "mode")),
            ([self.fill], ("mode", "constant")),
            ([self.encoding, *self.encoding_by.values()], ("auto", "onehot", "label")),
            ([self.scaling, *self.scaling_by.values()], SCALERS),
            ([self.unknown], ("ignore", "error")),
        ):
            for name in given:
                if name not in allowed:
                    raise ValueError(f"{name!r} is none of {allowed}")

    # --- fit ---

    def coerced(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.pii).withColumns({c: number(c) for c in self.continuous if c in df.columns})

    def fit(self, df: DataFrame) -> Preprocessor:
        """Fit on ``df``: one job for the numbers' fills and missing flags, one for the categories, one for the scales."""
        df = self.coerced(df)
        self.params = [*self._numbers(df), *self._categories(df)]
        self.params += self._scales(self.impute(df))
        return self

    def _numbers(self, df: DataFrame) -> list[Row]:
        hows = {c: self.numeric_by.get(c, self.numeric) for c in self.continuous}
        # medians and modes go over counted distinct values, in ranges; no state holds a column
        medians = [c for c in self.continuous if hows[c] == "median" and self.exact]
        found = {r["col"]: r["q"][0] for r in exact_quantiles(long_numbers(df, medians), ["col"], (0.5,)).collect()} if medians else {}
        modes = [c for c in self.continuous if hows[c] == "mode"]
        if modes:
            counts = long_numbers(df, modes).groupBy("col", "x").agg(F.count("*").alias("n"))
            found |= {r["col"]: r["x"] for r in counts.groupBy("col").agg(F.min(F.struct(-F.col("n"), "x")).alias("m")).select("col", "m.x").collect()}
        aggs = []
        for c in self.continuous:
            x = F.avg(c) if hows[c] == "mean" else F.lit(found.get(c)) if c in medians or c in modes else F.percentile_approx(c, 0.5, 100_000)
            aggs += [(F.first(x) if c in medians or c in modes else x).cast("double"), F.count_if(F.col(c).isNull())]
        aggs += [F.count_if(F.col(c).isNull()) for c in self.categorical]
        got = df.agg(F.count("*"), *aggs).first()[1:]
        rows, kinds = [], dict(df.dtypes)
        for i, c in enumerate(self.continuous):
            rows.append(Row("impute", c, "fill", 0, 0.0 if got[2 * i] is None else got[2 * i], None))
            rows.append(Row("impute", c, "nulls", 0, float(got[2 * i + 1]), kinds[c]))
        for i, c in enumerate(self.categorical):
            rows.append(Row("impute", c, "nulls", 0, float(got[2 * len(self.continuous) + i]), kinds[c]))
        return rows

    def _categories(self, df: DataFrame) -> list[Row]:
        f = kept_table(frequencies(df, self.categorical).select("col", "value", "n"), "frequencies") if self.categorical else None
        found: dict[str, list[tuple[str, int]]] = {c: [] for c in self.categorical}
        # per column its number of categories and its most frequent one
        top = F.min(F.struct(-F.col("n"), "value")).alias("top")
        sizes = {r["col"]: (r["count"], r["top"]["value"]) for r in f.groupBy("col").agg(F.count("*").alias("count"), top).collect()} if f else {}
        big = [c for c in self.categorical if sizes.get(c, (0,))[0] > self.large]
        for r in f.where(~F.col("col").isin(big)).collect() if f else []:  # at most ``large`` categories of each column
            found[r["col"]].append((r["value"], r["n"]))
        rows = self._large(f, big, {c: sizes[c][1] for c in big}) if big else []
        found = {c: v for c, v in found.items() if c not in big}
        for c, values in found.items():
            fill = min(values, key=lambda v: (-v[1], v[0]))[0] if values and self.fill == "mode" else "missing"
            rows.append(Row("impute", c, "fill", 0, None, fill))
            # every null becomes the fill, which so may be a category of its own
            names = sorted({v for v, _ in values} | ({fill} if self.fill == "constant" or not values else set()))
            how = self.encoding_by.get(c, self.encoding)
            onehot = how == "onehot" or how == "auto" and len(names) <= self.cap
            rows += [Row("onehot" if onehot else "label", c, "category", i, None, v) for i, v in enumerate(names)]
        return rows

    def _large(self, counts: DataFrame, big: list[str], modes: dict[str, str]) -> list[Row]:
        """Number the categories of large columns in a table; only their fills and sizes are parameters."""
        for c in big:
            if self.encoding_by.get(c, self.encoding) == "onehot":
                raise ValueError(f"{c} has more than {self.large} categories, too many for a column each")
        own = counts.where(F.col("col").isin(big))
        if self.fill == "constant":
            missing = counts.sparkSession.createDataFrame([(c, "missing", 0) for c in big], "col string, value string, n long")
            own = own.unionByName(missing).groupBy("col", "value").agg(F.sum("n").alias("n"))
        self.entries = dictionary(own)
        return [*[Row("impute", c, "fill", 0, None, modes[c] if self.fill == "mode" else "missing") for c in big], *self._large_sizes()]

    def _large_sizes(self) -> list[Row]:
        """Per large column: its number of categories, and the place of a category that is named Unknown."""
        sizes = self.entries.groupBy("col").agg(F.count("*").alias("n"), F.max(F.when(F.col("value") == "Unknown", F.col("ord"))).alias("unknown")).collect()
        return [Row("large", r["col"], "size", -1 if r["unknown"] is None else r["unknown"], float(r["n"]), None) for r in sizes]

    def _large_columns(self) -> dict[str, tuple[int, int]]:
        """Of each large column the last number and that of unknown categories."""
        out = {}
        for r in self._rows("large", "size"):
            extra = self.unknown == "ignore" and r[3] < 0
            out[r[1]] = (int(r[4]) - (not extra), int(r[4]) if extra else r[3])
        return {c: out[c] for c in self.categorical if c in out}

    def _entries(self, c: str) -> DataFrame:
        return self.entries.where(F.col("col") == c)

    def _scales(self, df: DataFrame) -> list[Row]:
        if not self.continuous:
            return []
        s = {r["col"]: r for r in long_numbers(df, self.continuous).groupBy("col").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")).collect()}
        rows = []
        for c in self.continuous:
            r = s.get(c)
            values = {"mean": r["mean"], "std": r["std"] or 1.0, "min": r["min"], "max": r["max"]} if r else {"mean": 0.0, "std": 1.0, "min": 0.0, "max": 1.0}
            rows += [Row("scale", c, k, 0, float(v), self.scaling_by.get(c, self.scaling)) for k, v in values.items()]
        return rows

    def _rows(self, stage: str, key: str | None = None) -> list[Row]:
        return [r for r in self.params if r[0] == stage and (key is None or r[2] == key)]

    def params_table(self, spark) -> DataFrame:
        small = spark.createDataFrame(self.params, PARAMS)
        if self.entries is None:
            return small
        large = self.entries.select(F.lit("dictionary").alias("stage"), "col", F.lit("category").alias("key"), F.col("ord").cast("int").alias("ord"), F.col("n").cast("double").alias("num"), F.col("value").alias("str"))
        return small.unionByName(large)

    def load(self, params: DataFrame) -> Preprocessor:
        """From a parameter table; the categories of large columns stay in it."""
        self.params = [Row(*r) for r in params.where("stage <> 'dictionary'").select("stage", "col", "key", "ord", "num", "str").collect()]
        if self._rows("large"):
            held = params.where("stage = 'dictionary'").select("col", F.col("str").alias("value"), F.col("num").cast("long").alias("n"))
            self.entries = dictionary(held)
        return self

    # --- apply ---

    def flagged(self) -> list[str]:
        return [r[1] for r in self._rows("impute", "nulls") if r[4] > 0]

    def impute(self, df: DataFrame) -> DataFrame:
        """Fills, and <c>_is_missing (0.0 or 1.0) for columns with nulls at fit time."""
        flags = {f"{c}_is_missing": F.col(c).isNull().cast("double") if c in df.columns else F.lit(1.0) for c in self.flagged()}
        fills = {}
        for r in self._rows("impute", "fill"):
            fill = F.lit(r[4]) if r[4] is not None else F.lit(r[5])
            own = (number(r[1]) if r[4] is not None else _text(r[1])) if r[1] in df.columns else F.lit(None)
            fills[r[1]] = F.coalesce(own, fill)
        return df.withColumns(flags).withColumns(fills)

    def unimpute(self, df: DataFrame) -> DataFrame:
        flags = [c for c in self.flagged() if f"{c}_is_missing" in df.columns]
        out = df.withColumns({c: F.when(F.col(f"{c}_is_missing") > 0.5, None).otherwise(F.col(c)) for c in flags})
        return out.drop(*[f"{c}_is_missing" for c in flags])

    def _names(self, stage: str) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for r in sorted(self._rows(stage, "category"), key=lambda r: (r[1], r[3])):
            out.setdefault(r[1], []).append(r[5])
        return {c: out[c] for c in self.categorical if c in out}

    def _labels(self, names: list[str]) -> list[str]:
        return [*names, "Unknown"] if self.unknown == "ignore" and "Unknown" not in names else names

    def encode(self, df: DataFrame) -> DataFrame:
        out, gone = {}, []
        for c, names in self._names("onehot").items():
            out |= {f"{c}_{v}": F.coalesce((_text(c) == v).cast("double"), F.lit(0.0)) for v in names}
            gone.append(c)
        for c, names in self._names("label").items():
            all_names = self._labels(names)
            found = F.array_position(F.array(*[F.lit(v) for v in all_names]), _text(c)) - 1
            known = F.when(found >= 0, found)
            if self.unknown == "ignore":
                index = F.coalesce(known, F.lit(all_names.index("Unknown")))
            else:
                index = F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.coalesce(known, F.raise_error(F.concat(F.lit(f"{c}: unknown category "), _text(c))).cast("long")))
            out[c] = index / F.lit(float(max(len(all_names) - 1, 1))) if self.scale_labels else index.cast("double")
        for c, (last, unknown) in self._large_columns().items():
            df = looked_up(df.withColumn(c, _text(c)), self._entries(c), c, "value", "ord", f"_{c}_at")
            known = F.col(f"`_{c}_at`")
            if self.unknown == "ignore":
                index = F.coalesce(known, F.lit(unknown))
            else:
                index = F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.coalesce(known, F.raise_error(F.concat(F.lit(f"{c}: unknown category "), _text(c))).cast("long")))
            out[c] = index / F.lit(float(max(last, 1))) if self.scale_labels else index.cast("double")
            gone.append(f"_{c}_at")
        return df.withColumns(out).drop(*gone)

    def decode(self, df: DataFrame) -> DataFrame:
        out, gone = {}, []
        for c, names in self._names("onehot").items():
            values = F.array(*[F.col(f"`{c}_{v}`") for v in names])
            top = F.array_max(values)
            out[c] = F.when(top >= 1e-5, F.element_at(F.array(*[F.lit(v) for v in names]), F.array_position(values, top).cast("int")))
            gone += [f"{c}_{v}" for v in names]
        for c, names in self._names("label").items():
            all_names = self._labels(names)
            top = len(all_names) - 1
            index = F.bround(F.col(c) * (max(top, 1) if self.scale_labels else 1), 0)
            out[c] = F.element_at(F.array(*[F.lit(v) for v in all_names]), (F.least(F.greatest(index, F.lit(0)), F.lit(top)) + 1).cast("int"))
        for c, (last, unknown) in self._large_columns().items():
            index = F.least(F.greatest(F.bround(F.col(c) * (max(last, 1) if self.scale_labels else 1), 0), F.lit(0)), F.lit(last)).cast("long")
            df = looked_up(df.withColumn(f"_{c}_at", index), self._entries(c), f"_{c}_at", "ord", "value", f"_{c}_is")
            value = F.col(f"`_{c}_is`")
            out[c] = F.when(F.col(f"`_{c}_at`").isNotNull(), F.coalesce(value, F.lit("Unknown"))) if self.unknown == "ignore" else value
            gone += [f"_{c}_at", f"_{c}_is"]
        return df.withColumns(out).drop(*gone)

    def _scale(self, c: str) -> tuple[str, dict[str, float]]:
        rows = [r for r in self._rows("scale") if r[1] == c]
        return rows[0][5], {r[2]: r[4] for r in rows}

    def _range(self, how: str, s: dict[str, float]) -> tuple[float, float]:
        import math

        lo, hi = (math.log1p(max(s["min"], 0)), math.log1p(max(s["max"], 0))) if how == "log1p" else (s["min"], s["max"])
        return lo, (hi - lo) or 1.0

    def scale(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.continuous:
            how, s = self._scale(c)
            if how == "standard":
                out[c] = (F.col(c) - s["mean"]) / s["std"]
                continue
            x = F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c), F.lit(0.0)))) if how == "log1p" else F.col(c)
            lo, width = self._range(how, s)
            out[c] = (x - lo) / width * (self.high - self.low) + self.low
        return df.withColumns(out)

    def unscale(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.continuous:
            how, s = self._scale(c)
            if how == "standard":
                out[c] = F.col(c) * s["std"] + s["mean"]
                continue
            lo, width = self._range(how, s)
            x = (F.col(c) - self.low) / (self.high - self.low) * width + lo
            out[c] = F.expm1(x) if how == "log1p" else x
        return df.withColumns(out)

    def transform(self, df: DataFrame) -> DataFrame:
        """One projection: coerce, drop identifiers, impute, encode, scale."""
        return self.scale(self.encode(self.impute(self.coerced(df))))

    def inverse(self, df: DataFrame, bounds: dict[str, tuple[float, float]] | None = None, order: list[str] | None = None) -> DataFrame:
        """One projection back: unscale, decode, clamp to bounds, restore types and nulls, restore the order."""
        out = self.decode(self.unscale(df))
        fixed = {}
        kinds = {r[1]: r[5] for r in self._rows("impute", "nulls")}
        for c in self.continuous:
            x = F.col(c)
            lo, hi = (bounds or {}).get(c, (None, None))
            if lo is not None:
                x = F.when(x.isNotNull(), F.greatest(x, F.lit(float(lo))))
            if hi is not None:
                x = F.when(x.isNotNull(), F.least(x, F.lit(float(hi))))
            fixed[c] = F.bround(x, 0).cast("long") if self._integer(kinds.get(c)) else x
        out = self.unimpute(out.withColumns(fixed))
        return out.select(*order) if order else out

    def remember_types(self, df: DataFrame) -> Preprocessor:
        """Keep the original types, so that ``inverse`` gives integers back; call after ``fit``."""
        kinds = dict(df.dtypes)
        self.params = [Row(r[0], r[1], r[2], r[3], r[4], kinds[r[1]]) if r[0] == "impute" and r[2] == "nulls" and r[1] in kinds else r for r in self.params]
        return self

    @staticmethod
    def _integer(kind: str | None) -> bool:
        return kind in ("tinyint", "smallint", "int", "bigint")

    # --- layout ---

    def layout(self) -> list[tuple[str, str, list[str]]]:
        """(column, kind, encoded columns) in vector order: continuous, one-hot groups, labels, indicators."""
        out = [(c, "continuous", [c]) for c in self.continuous]
        out += [(c, "onehot", [f"{c}_{v}" for v in names]) for c, names in self._names("onehot").items()]
        out += [(c, "label", [c]) for c in [*self._names("label"), *self._large_columns()]]
        return out + [(f"{c}_is_missing", "indicator", [f"{c}_is_missing"]) for c in self.flagged()]

    def vector(self, df: DataFrame, name: str = "features") -> DataFrame:
        """``df`` (encoded) with all encoded columns as one array in layout order; absent ones are 0."""
        cols = [c for _, _, group in self.layout() for c in group]
        return df.withColumn(name, F.array(*[F.col(f"`{c}`").cast("double") if c in df.columns else F.lit(0.0) for c in cols]))

    def from_vector(self, df: DataFrame, name: str = "features") -> DataFrame:
        cols = [c for _, _, group in self.layout() for c in group]
        keep = [c for c in df.columns if c != name and c not in cols]
        return df.select(*keep, *[F.col(name)[i].alias(c) for i, c in enumerate(cols)])


def forward_fill(df: DataFrame, by: list[str], order: str, cols: list[str]) -> DataFrame:
    """Nulls take the last value before them within their group."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def interpolate(df: DataFrame, by: list[str], order: str, cols: list[str]) -> DataFrame:
    """Nulls between two values take the straight line in ``order`` between them; others stay."""
    before = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*by).orderBy(order).rowsBetween(0, W.unboundedFollowing)
    t = F.col(order).cast("double")
    out = {}
    for c in cols:
        at = F.when(F.col(c).isNotNull(), t)
        t0, t1 = F.last(at, ignorenulls=True).over(before), F.first(at, ignorenulls=True).over(after)
        x0, x1 = F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(after)
        out[c] = F.coalesce(F.col(c), x0 + (x1 - x0) * F.try_divide(t - t0, t1 - t0))
    return df.withColumns(out)


def sentinel_fill(df: DataFrame, cols: list[str], value: float = -999.0) -> DataFrame:
    flags = {f"{c}_is_missing": F.col(c).isNull().cast("double") for c in cols}
    return df.withColumns(flags).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(value)) for c in cols})
