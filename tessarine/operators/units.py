"""Quantities recorded in different units, brought to the common unit of their metric.

A calibrated tree ensemble is trained on rows whose unit is written down, and predicts the unit of every row
from the size and shape of its numbers, its source, category and neighbouring fields. What is written is then held
against the prediction: the unit column, or else the text beside the same number in the title. Where nothing
known is written, only confident predictions are converted and the others are marked for review; where a confident
prediction stands against what is written, the row is converted as written and marked to be looked at.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# For each metric its common unit, and for every other unit the factor (and the zero
# point, added first) that brings it there, with its spellings in lower case.
UNITS: dict[str, list[tuple[str, float, float, list[str]]]] = {
    "market_cap": [
        ("usd", 1.0, 0.0, ["$", "us$", "usd", "dollar", "dollars", "us dollars"]),
        ("thousand usd", 1e3, 0.0, ["k$", "$k", "k usd", "usd k", "thousand usd", "thousand dollars", "thousands of dollars"]),
        ("million usd", 1e6, 0.0, ["$m", "$mm", "$mn", "m$", "usd mm", "usd million", "million usd", "mn usd", "mn dollars", "million dollars"]),
        ("billion usd", 1e9, 0.0, ["$bn", "$b", "bn$", "usd billion", "usd bn", "billion usd", "bn usd", "bn dollars", "billion dollars"]),
        ("trillion usd", 1e12, 0.0, ["$tn", "$t", "usd trillion", "usd tn", "trillion usd", "tn usd", "tn dollars", "trillion dollars"]),
    ],
    "price": [
        ("usd", 1.0, 0.0, ["$", "us$", "usd", "dollar", "dollars", "us dollars"]),
        ("cent", 0.01, 0.0, ["¢", "c", "cent", "cents", "us cent", "us cents"]),
        ("thousand usd", 1e3, 0.0, ["k$", "$k", "us$k", "k usd", "usd k", "thousand usd", "thousand dollars", "thousands of dollars"]),
        ("million usd", 1e6, 0.0, ["$m", "million usd", "mn usd", "mn dollars", "million dollars"]),
    ],
    "interest_rate": [
        ("percent", 1.0, 0.0, ["%", "pct", "percent", "per cent", "percentage points"]),
        ("basis point", 0.01, 0.0, ["bp", "bps", "basis point", "basis points"]),
        ("ratio", 100.0, 0.0, ["ratio", "fraction"]),
        ("permille", 0.1, 0.0, ["‰", "permille", "per mille"]),
    ],
    "temperature": [
        ("degC", 1.0, 0.0, ["c", "°c", "℃", "celsius", "degc", "deg c", "deg. c", "degree c", "degrees c", "degrees celsius"]),
        ("degF", 5.0 / 9.0, -32.0, ["f", "°f", "℉", "fahrenheit", "degf", "deg f", "deg. f", "degree f", "degrees f", "degrees fahrenheit"]),
        ("kelvin", 1.0, -273.15, ["k", "kelvin", "kelvins", "°k"]),
    ],
    "rainfall": [
        ("mm", 1.0, 0.0, ["mm", "millimetre", "millimetres", "millimeter", "millimeters"]),
        ("cm", 10.0, 0.0, ["cm", "centimetre", "centimetres", "centimeter", "centimeters"]),
        ("m", 1000.0, 0.0, ["m", "metre", "metres", "meter", "meters"]),
        ("inch", 25.4, 0.0, ["in", "in.", "inch", "inches", '"']),
    ],
    "wind_speed": [
        ("km/h", 1.0, 0.0, ["km/h", "kmh", "kph", "kilometres per hour", "kilometers per hour"]),
        ("mph", 1.609344, 0.0, ["mph", "mi/h", "miles per hour"]),
        ("knot", 1.852, 0.0, ["kn", "kt", "kts", "knot", "knots"]),
        ("m/s", 3.6, 0.0, ["m/s", "mps", "metres per second", "meters per second"]),
    ],
    "payload_mass": [
        ("kg", 1.0, 0.0, ["kg", "kgs", "kilo", "kilos", "kilogram", "kilograms"]),
        ("g", 0.001, 0.0, ["g", "gram", "grams"]),
        ("tonne", 1000.0, 0.0, ["t", "tonne", "tonnes", "metric ton", "metric tons"]),
        ("pound", 0.45359237, 0.0, ["lb", "lbs", "pound", "pounds"]),
    ],
    "energy_output": [
        ("MWh", 1.0, 0.0, ["mwh", "megawatt hour", "megawatt hours", "megawatt-hours"]),
        ("kWh", 0.001, 0.0, ["kwh", "kilowatt hours", "kilowatt-hour", "kilowatt-hours"]),
        ("GWh", 1e3, 0.0, ["gwh", "gigawatt hour", "gigawatt hours", "gigawatt-hours"]),
        ("TWh", 1e6, 0.0, ["twh", "terawatt hours", "terawatt-hours"]),
    ],
    "runtime": [
        ("min", 1.0, 0.0, ["m", "min", "mins", "minute", "minutes"]),
        ("second", 1.0 / 60.0, 0.0, ["s", "sec", "secs", "second", "seconds"]),
        ("hour", 60.0, 0.0, ["h", "hr", "hrs", "hour", "hours"]),
        ("day", 1440.0, 0.0, ["d", "day", "days"]),
    ],
    "votes": [
        ("count", 1.0, 0.0, ["count", "vote", "votes", "ballot", "ballots"]),
        ("thousand", 1e3, 0.0, ["k", "k votes", "thousand", "thousands", "thousand votes", "thousands of votes"]),
        ("lakh", 1e5, 0.0, ["lakh", "lakhs", "lakh votes"]),
        ("million", 1e6, 0.0, ["m", "mn", "million", "millions", "mn votes", "million votes", "m votes"]),
    ],
}
#: Scales behind a number with a currency sign.
SCALES = ["k", "m", "mm", "mn", "bn", "b", "tn", "t"]
#: Texts of a unit column that say nothing.
SAYS_NOTHING = ["", "-", "n/a", "na", "none", "null", "nan", "unknown", "?"]
#: Rows that the tree ensemble is fitted on, at most; and the confidence from which it converts, or doubts what is written.
TRAIN_ROWS = 20_000
CONFIDENT = 0.9
#: Values of the source, and of each neighbouring field, that get a feature of their own: the most frequent ones.
ONE_HOT = 12
_TREES, _DEPTH, _LEAF, _SEED, _CALIBRATION_BINS = 40, 10, 10, 7, 10


def unit_table(spark: SparkSession) -> DataFrame:
    """Every spelling of every unit: __metric, __alias, __unit, __factor, __zero. Its size is fixed."""
    rows = [(m, a, unit, factor, zero) for m, units in UNITS.items() for unit, factor, zero, names in units for a in names]
    return spark.createDataFrame(rows, "__metric string, __alias string, __unit string, __factor double, __zero double")


def _quantities(title: Column) -> Column:
    """Every number of a title (v) with the spelling of the unit that is written around it (u)."""
    names = sorted({a for units in UNITS.values() for _, _, _, every in units for a in every if a[0] != "$"} | set(SCALES), key=lambda a: (-len(a), a))
    words = "|".join(re.escape(a) for a in names).replace(r"\ ", r"\s+")
    pattern = rf"(?<![\p{{L}}\p{{N}}.,])((?:us)?\$)?\s?(-?[0-9]+(?:\.[0-9]+)?(?:e-?[0-9]+)?)[\s-]?(?:({words})(?![\p{{L}}\p{{N}}]))?"
    text = F.regexp_replace(F.lower(title), r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
    part = lambda k: F.regexp_extract_all(text, F.lit(pattern), k)
    found = F.arrays_zip(part(1).alias("lead"), part(2).alias("number"), part(3).alias("tail"))
    # Behind a currency sign only a scale belongs to the number: "$70 in April" is in dollars.
    tail = lambda x: F.when((x["lead"] == "") | x["tail"].isin(SCALES), x["tail"]).otherwise("")
    return F.transform(found, lambda x: F.struct(x["number"].cast("double").alias("v"), F.regexp_replace(F.concat(x["lead"], tail(x)), r"\s+", " ").alias("u")))


def _beside(quantities: Column, value: Column) -> Column:
    """The first unit that a title gives to ``value``."""
    same = lambda x: (x["u"] != "") & (F.abs(x["v"] - value) <= F.abs(value) * 1e-9 + 1e-12)
    return F.get(F.filter(quantities, same), F.lit(0))["u"]


def with_title_unit(df: DataFrame, title: str, low: str, high: str, out: str, where: Column) -> DataFrame:
    """``out``: the unit beside ``low``, or else beside ``high``, in the title; only where ``where`` holds."""
    held = df.withColumn("__quantities", F.when(where, _quantities(F.col(title))))
    return held.withColumn(out, F.coalesce(_beside(F.col("__quantities"), F.col(low)), _beside(F.col("__quantities"), F.col(high)))).drop("__quantities")


def _frequent(known: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """The most frequent values of each column, at most ``ONE_HOT``."""
    out = {}
    for c in columns:
        top = known.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(ONE_HOT)
        out[c] = [r[0] for r in top.collect()]
    return out


def _features(df: DataFrame, shown: Mapping[str, Sequence[str]]) -> DataFrame:
    """Magnitude, digits and shape of the range, the metric, and the values ``shown`` of source and neighbouring fields as a vector."""
    size = lambda c: F.coalesce(F.log10(F.abs(F.col(c)) + 1e-12), F.lit(-20.0))
    mantissa = lambda c: F.coalesce(F.abs(F.col(c)) / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(F.col(c)) + 1e-12))), F.lit(0.0))
    numbers = [
        size("__low"), size("__high"), mantissa("__low"), mantissa("__high"), F.signum(F.coalesce("__low", F.lit(0.0))),
        F.coalesce(F.try_divide("__high", "__low"), F.lit(0.0)), (F.col("__low") == F.floor("__low")).cast("double"),
        *[(F.col("__metric") == m).cast("double") for m in UNITS],
        *[F.col(c).eqNullSafe(v).cast("double") for c, values in shown.items() for v in values],
    ]
    return df.withColumn("__x", array_to_vector(F.array(*[F.coalesce(F.nanvl(n.cast("double"), F.lit(0.0)), F.lit(0.0)) for n in numbers])))


def predict_units(known: DataFrame, rows: DataFrame, fields: Sequence[str] = (), train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``rows`` with ``__guess`` and ``__confidence`` predicted from ``known``, whose ``__unit`` is certain.

    A random forest is fitted on at most ``train_rows`` rows drawn by a hash of their content; a fifth
    of them is held out, and the share of right answers among held-out rows of like score (bins of
    equal width, made monotone) is the confidence that a prediction gets.
    """
    spark = known.sparkSession
    names = [(m, u) for m, units in UNITS.items() for u, *_ in units]
    label = F.element_at(F.create_map(*[F.lit(x) for k, (m, u) in enumerate(names) for x in (f"{m}|{u}", float(k))]), F.concat_ws("|", "__metric", "__unit"))
    drawn = known.withColumn("__draw", F.xxhash64("__key", "__source", "__low", "__high")).orderBy("__draw", "__low", "__high").limit(train_rows).withColumn("__y", label).where("__y is not null").persist()
    try:
        shown = _frequent(drawn, ["__source", *fields])
        shaped = _features(drawn, shown).select("__x", "__y", "__metric", "__draw")
        fit, held = shaped.where("pmod(__draw, 5) > 0"), shaped.where("pmod(__draw, 5) = 0")
        if fit.limit(2).count() < 2:
            return rows.withColumns({"__guess": F.lit(None).cast("string"), "__confidence": F.lit(0.0)})
        forest = RandomForestClassifier(featuresCol="__x", labelCol="__y", probabilityCol="__p", predictionCol="__yhat", rawPredictionCol="__raw", numTrees=_TREES, maxDepth=_DEPTH, maxBins=64, minInstancesPerNode=_LEAF, seed=_SEED).fit(fit)
        score = lambda d: _best_of_metric(forest.transform(d), names, forest.numClasses)
        level = lambda c: F.least(F.floor(c * _CALIBRATION_BINS), F.lit(_CALIBRATION_BINS - 1)).cast("int")
        bins = {r["b"]: (r["n"], r["right"]) for r in score(held).groupBy(level(F.col("__score")).alias("b")).agg(F.count("*").alias("n"), F.sum((F.col("__best") == F.col("__y")).cast("double")).alias("right")).collect()}
    finally:
        drawn.unpersist()
    levels, seen = [], 0.0
    for b in range(_CALIBRATION_BINS):
        n, right = bins.get(b, (0, 0.0))
        seen = max(seen, right / (n + 2.0))  # two pseudo-rows keep sparse bins from certainty
        levels.append(seen)
    unit = F.element_at(F.array(*[F.lit(u) for _, u in names]), (F.col("__best") + 1).cast("int"))
    sure = F.element_at(F.array(*[F.lit(v) for v in levels]), level(F.col("__score")) + 1)
    return score(_features(rows, shown)).withColumns({"__guess": F.when(F.col("__metric").isin(list(UNITS)), unit), "__confidence": F.when(F.col("__score").isNotNull(), sure).otherwise(0.0)}).drop("__x", "__p", "__raw", "__yhat", "__best", "__score")


def _best_of_metric(df: DataFrame, names: list[tuple[str, str]], classes: int) -> DataFrame:
    """The likeliest unit among those of the row's metric (__best) and its share of their votes (__score)."""
    p = vector_to_array("__p")
    share = lambda k: F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)) if k < classes else F.lit(0.0)
    shares = lambda m: F.array(*[F.struct(share(k).alias("s"), F.lit(float(k)).alias("k")) for k, (own, _) in enumerate(names) if own == m])
    every = F.lit(None).cast("array<struct<s:double,k:double>>")
    for m in UNITS:
        every = F.when(F.col("__metric") == m, shares(m)).otherwise(every)
    held = df.withColumn("__every", every)
    total = F.aggregate("__every", F.lit(0.0), lambda a, x: a + x["s"])
    return held.withColumns({"__score": F.array_max("__every")["s"] / F.when(total > 0, total), "__best": F.array_max("__every")["k"]}).drop("__every")


def common_units(df: DataFrame, key: str, title: str, source: str | None = None, metric: str = "metric", low: str = "threshold_low", high: str = "threshold_high", unit: str = "unit", fields: Sequence[str] = (), check: bool = False, train_rows: int = TRAIN_ROWS, confident: float = CONFIDENT) -> DataFrame:
    """The bounds of every row that has a metric and a bound, in the common unit of the metric.

    Returns ``key``, metric, common_low, common_high, unit_found (canonical name), unit_from ('column',
    'title', 'predicted' or 'review'), confidence (1 for units that are written down) and doubtful. The unit column counts
    where it holds a known spelling, else the title does, else the prediction. Rows whose unit stays
    uncertain, and rows of a metric that is not in ``UNITS``, are marked 'review' and have null bounds. With ``check`` the
    ensemble sees every row: doubtful tells that a confident prediction is another unit than the written one (null without ``check``, and
    where none is written). ``fields`` are neighbouring columns to predict from. Rows with a null metric
    or without any bound are left out. NaN bounds count as null. Repeated rows stay repeated. Other
    columns are never read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    near = {f"__field{k}": F.lower(F.trim(F.col(c).cast("string"))) for k, c in enumerate(fields)}
    base = df.select(
        F.col(key).alias("__key"), F.col(title).alias("__title"), (F.col(source) if source else F.lit("")).alias("__source"),
        F.lower(F.trim(F.col(metric))).alias("__metric"), number(low).alias("__low"), number(high).alias("__high"),
        F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.col(unit), r"[\s\x{00A0}]+", " "))), r"^\s+|\s+$", "").alias("__said"), *[c.alias(name) for name, c in near.items()],
    ).where((F.col("__metric") != "") & (F.col("__low").isNotNull() | F.col("__high").isNotNull()))
    units = unit_table(spark)
    column = F.broadcast(units.withColumnsRenamed({"__alias": "__said", "__unit": "__in_column"}).select("__metric", "__said", "__in_column"))
    base = base.join(column, ["__metric", "__said"], "left")
    base = with_title_unit(base, "__title", "__low", "__high", "__beside", F.col("__in_column").isNull())
    beside = F.broadcast(units.withColumnsRenamed({"__alias": "__beside", "__unit": "__in_title"}).select("__metric", "__beside", "__in_title"))
    base = base.join(beside, ["__metric", "__beside"], "left").withColumn("__unit", F.coalesce("__in_column", "__in_title"))
    columns = ["__key", "__source", "__metric", "__low", "__high", "__unit", "__in_column", *near]
    base = base.select(*columns)
    known = base.where("__unit is not null")
    missing = base.where("__unit is null")
    asked = base if check else missing
    blank = {"__guess": F.lit(None).cast("string"), "__confidence": F.lit(0.0)}
    if asked.isEmpty():
        told = asked.withColumns(blank)
    else:
        told = predict_units(known, asked, list(near), train_rows)
    whole = told if check else known.withColumns(blank).unionByName(told)
    written, sure = F.col("__unit").isNotNull(), F.col("__guess").isNotNull() & (F.col("__confidence") >= confident)
    whole = whole.withColumns({
        "__from": F.when(F.col("__in_column").isNotNull(), "column").when(written, "title").when(sure, "predicted").otherwise("review"),
        "__doubtful": F.when(written & F.col("__guess").isNotNull(), sure & (F.col("__guess") != F.col("__unit"))),
    }).withColumns({"__confidence": F.when(written, 1.0).otherwise(F.col("__confidence")), "__unit": F.coalesce("__unit", "__guess")})
    factors = F.broadcast(spark.createDataFrame([(m, u, f, z) for m, every in UNITS.items() for u, f, z, _ in every], "__metric string, __unit string, __f double, __z double"))
    whole = whole.join(factors, ["__metric", "__unit"], "left")
    bound = lambda c: F.when(F.col("__from") != "review", (F.col(c) + F.col("__z")) * F.col("__f"))
    return whole.select(
        F.col("__key").alias(key), F.col("__metric").alias("metric"), bound("__low").alias("common_low"), bound("__high").alias("common_high"),
        F.col("__unit").alias("unit_found"), F.col("__from").alias("unit_from"), F.col("__confidence").alias("confidence"), F.col("__doubtful").alias("doubtful"),
    )
