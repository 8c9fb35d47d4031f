"""Quantities recorded in different units (problem 1): every listing with grams and US dollars.

What a title states is taken at its word. Where it states no mass, the unit of ``weight_g`` is missing: a
random forest, fitted on a bounded sample of the listings whose titles do state one and calibrated on
held-out ones by isotonic regression, predicts it from magnitude, seller, category and neighbouring fields,
what the seller's notes say among them. Confident predictions are converted; the others get no mass and are
routed for review. An exact rule (the unit the notes give, else grams) follows as a check: it settles what is
under review and says where the forest disagrees.

Scale: titles are parsed once, into a narrow stored table; one scan of that for the sample (its size is a
parameter and all that reaches the driver), one for the result;
the registry and the rates are joined by key and left to the optimizer, which broadcasts them while they
are below its threshold. No listing moves but the flagged ones, for the final distinct.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siderite.functions.units import GRAMS, note_unit, title_currency, unit_grams, with_currency, with_title_mass
from siderite.session import stored

UNITS = list(GRAMS)
#: Listings that the classifier is fitted on, calibrated with and measured on, at most; a documented bound.
FIT_ROWS, HELD_OUT_ROWS, MEASURED_ROWS = 8_000, 4_000, 4_000
#: A prediction at this calibrated probability or more counts as confident.
CONFIDENT = 0.98
#: A recorded mass names its unit if the title's mass agrees with it this closely.
LABEL_TOLERANCE = 0.03
OFF = 0.01
#: The families that a listing's type can be, in display order.
FAMILIES = ["ordinary chondrite", "carbonaceous chondrite", "enstatite chondrite", "chondrite", "achondrite", "lunar", "martian", "iron", "pallasite", "mesosiderite", "unknown"]
FEATURES = ["f_weight", "f_price", "f_ratio", "f_family", "f_named", *(f"f_note_{u}" for u in UNITS), *(f"f_seen_{u}" for u in UNITS)]
EMPTY_SHARES = {f"f_seen_{u}": 0.0 for u in UNITS}


def parsed_listings(listings: DataFrame, sources: DataFrame) -> DataFrame:
    """Listings with title_mass_g, note_unit, currency_code, currency_scale; rows keep their number.

    A seller that the registry names twice counts with its first notes in sort order; one that it doesn't
    name is taken to quote grams.
    """
    notes = sources.groupBy(F.col("name").alias("source")).agg(F.min(note_unit(F.col("notes"))).alias("note_unit"))
    wanted = ["id", "source", "title", "canonical_name_status", "price", "currency", "weight_g", "price_usd", "fx_rate_date", "meteorite_type"]
    rows = with_title_mass(listings.select(wanted))
    spelled = F.coalesce("currency", F.when(F.col("price").isNotNull(), title_currency(F.col("title"))))
    rows = with_currency(rows.withColumn("_spelled", spelled), "_spelled").drop("_spelled", "title", "currency")
    return rows.join(notes, "source", "left").withColumn("note_unit", F.coalesce("note_unit", F.lit("g")))


def _log(x: Column) -> Column:
    return F.coalesce(F.when(x > 0, F.log10(x)), F.lit(-9.0))


def _labelled(parsed: DataFrame) -> DataFrame:
    """Rows whose title tells the unit of weight_g, with that unit as ``label``."""
    label = F.lit(None).cast("int")
    for i, unit in enumerate(UNITS):
        label = F.when(F.abs(F.col("weight_g") * GRAMS[unit] / F.col("title_mass_g") - 1) <= LABEL_TOLERANCE, i).otherwise(label)
    return parsed.where("weight_g > 0 AND title_mass_g IS NOT NULL").withColumn("label", label).where("label IS NOT NULL")


def _features(rows: DataFrame) -> DataFrame:
    family = F.array_position(F.array(*[F.lit(x) for x in FAMILIES]), F.coalesce("meteorite_type", F.lit("unknown"))).cast("double")
    columns = {
        "f_weight": _log(F.col("weight_g")), "f_price": _log(F.col("price")), "f_ratio": _log(F.col("price") / F.nullif(F.col("weight_g"), F.lit(0.0))),
        "f_family": family, "f_named": (F.coalesce("canonical_name_status", F.lit("")) == "metbull_verified").cast("double"),
    }
    return rows.withColumns(columns | {f"f_note_{u}": (F.col("note_unit") == u).cast("double") for u in UNITS})


class UnitModel:
    """A calibrated forest for the unit of a mass; ``fit`` bounds what it reads into the driver."""

    def __init__(self, forest: RandomForestClassificationModel | None, isotonic: IsotonicRegressionModel | None, shares: DataFrame | None):
        self.forest, self.isotonic, self.shares = forest, isotonic, shares
        self.unseen = None  # bounded labelled rows that neither fit nor calibration has seen
        self.assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")

    @classmethod
    def fit(cls, parsed: DataFrame, fit_rows: int = FIT_ROWS, held_out_rows: int = HELD_OUT_ROWS) -> UnitModel:
        """Fits on the first rows of a fixed pseudo-random order; without labelled rows the model predicts nothing."""
        spark = parsed.sparkSession
        kept = ["source", "label", "weight_g", "price", "meteorite_type", "canonical_name_status", "note_unit"]
        wanted = fit_rows + held_out_rows + MEASURED_ROWS
        labelled = _labelled(parsed).select(*kept, F.xxhash64("id", "source", "weight_g").alias("draw"))
        # the draw is a uniform 64-bit number: below this bound lie about 1.5 times the rows wanted, so that no
        # task sorts or sends more than its share of them
        share = min(1.0, 1.5 * wanted / max(1, labelled.count()))
        bound = min(2**63 - 1, int(-(2**63) + share * 2**64))
        sample = labelled.where(F.col("draw") <= bound).orderBy("draw", *kept).limit(wanted).toPandas()  # bounded by the two parameters
        model = cls(None, None, None)
        if len(sample) < 50:
            return model
        cut, end = len(sample) * fit_rows // wanted, len(sample) * (fit_rows + held_out_rows) // wanted
        seen = sample.iloc[:cut].groupby(["source", "label"]).size().unstack(fill_value=0)
        seen = seen.div(seen.sum(axis=1), axis=0).reindex(columns=range(len(UNITS)), fill_value=0.0)
        seen.columns = [f"f_seen_{u}" for u in UNITS]
        model.shares = spark.createDataFrame(seen.reset_index())
        schema = "source string, label int, weight_g double, price double, meteorite_type string, canonical_name_status string, note_unit string, draw bigint"
        whole = [spark.createDataFrame(part.astype(object).where(part.notna(), None), schema) for part in (sample.iloc[:cut], sample.iloc[cut:end], sample.iloc[end:])]
        parts, model.unseen = [model._vectors(part) for part in whole[:2]], whole[2]
        forest = RandomForestClassifier(labelCol="label", numTrees=16, maxDepth=7, minInstancesPerNode=2, subsamplingRate=0.8, seed=11)
        model.forest = forest.fit(parts[0].coalesce(2))
        held_out = model._scored(parts[1]).select((F.col("predicted") == F.col("label")).cast("double").alias("right"), F.col("raw").alias("score"))
        model.isotonic = IsotonicRegression(featuresCol="score", labelCol="right", predictionCol="confidence").fit(held_out.coalesce(1))
        return model

    def measured(self) -> DataFrame:
        """(measure, value) on the labelled rows that the model hasn't seen: how many, accuracy, the share it is confident of and its
        accuracy there, and the calibration error (mean difference of confidence and accuracy over tenths of the confidence)."""
        if self.forest is None:
            raise ValueError("nothing was fitted")
        right = F.array_position(F.array(*[F.lit(u) for u in UNITS]), F.col("unit")) - 1 == F.col("label")
        judged = self.predict(self.unseen).select(right.cast("double").alias("right"), "confidence", (F.col("confidence") >= CONFIDENT).alias("sure"))
        tenths = judged.groupBy(F.floor(F.col("confidence") * 10)).agg(F.count(F.lit(1)).alias("n"), F.sum("right").alias("right"), F.sum("confidence").alias("claimed"), F.count_if("sure").alias("sure"), F.sum(F.when(F.col("sure"), F.col("right"))).alias("sure_right"))
        n = F.sum("n")
        one = tenths.agg(n.cast("double").alias("rows"), (F.sum("right") / n).alias("accuracy"), (F.sum("sure") / n).alias("confident_share"), (F.sum("sure_right") / F.nullif(F.sum("sure"), F.lit(0))).alias("confident_accuracy"), (F.sum(F.abs(F.col("claimed") - F.col("right"))) / n).alias("calibration_error"))
        return one.select(F.explode(F.create_map(*[x for c in one.columns for x in (F.lit(c), F.col(c))])).alias("measure", "value"))

    def _vectors(self, rows: DataFrame) -> DataFrame:
        return self.assembler.transform(_features(rows).join(self.shares, "source", "left").fillna(EMPTY_SHARES))

    def _scored(self, vectors: DataFrame) -> DataFrame:
        scored = self.forest.transform(vectors)
        return scored.withColumn("raw", F.array_max(vector_to_array("probability"))).withColumn("predicted", F.col("prediction").cast("int"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with ``unit`` and its calibrated ``confidence``; null and 0 if nothing could be learned."""
        kept = rows.columns
        if self.forest is None:
            return rows.withColumns({"unit": F.lit(None).cast("string"), "confidence": F.lit(0.0)})
        scored = self.isotonic.transform(self._scored(self._vectors(rows)).withColumn("score", F.col("raw")))
        unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), F.col("predicted") + 1)
        return scored.select(*kept, unit.alias("unit"), "confidence")


def open_rates(fx_rates: DataFrame, provider: str) -> DataFrame:
    """(fx_rate_date, currency_code, rate): the provider's rates, of repeated ones the last published."""
    rows = fx_rates.where(F.col("provider") == provider)
    rate = F.max(F.struct("published_at", "rate_to_usd"))["rate_to_usd"]
    return rows.groupBy(F.col("rate_date").alias("fx_rate_date"), F.col("currency").alias("currency_code")).agg(rate.alias("rate"))


def common_units(listings: DataFrame, sources: DataFrame, fx_rates: DataFrame, provider: str = "open board") -> DataFrame:
    """One row for each listing row: id, source, weight_g, price, price_usd as recorded, and

    mass_g with mass_basis: ``title`` (as stated there), ``predicted`` (weight_g in the unit the forest is confident
    of), ``review`` (not confident: no mass_g), null without any mass; unit and unit_confidence; rule_g, the
    title's mass, else weight_g in the unit of the seller's notes, else in grams, which settles every row;
    usd (price in dollars at the provider's rate of fx_rate_date; null where price, unit or rate is unknown).
    """
    return convert(*parsed_and_fitted(listings, sources), fx_rates, provider)


def parsed_and_fitted(listings: DataFrame, sources: DataFrame) -> tuple[DataFrame, UnitModel]:
    """The parsed listings, stored, and the model that was fitted on them."""
    parsed = stored(parsed_listings(listings, sources))  # each title is parsed once
    return parsed, UnitModel.fit(parsed)


def convert(parsed: DataFrame, model: UnitModel, fx_rates: DataFrame, provider: str = "open board") -> DataFrame:
    """See :func:`common_units`; parsed: rows of :func:`parsed_listings`."""
    usable = parsed.withColumn("weight_g", F.when(~F.isnan("weight_g"), F.col("weight_g")))
    stated = usable.where("title_mass_g IS NOT NULL OR weight_g IS NULL")
    open_rows = model.predict(usable.where("title_mass_g IS NULL AND weight_g IS NOT NULL"))
    sure = F.col("confidence") >= CONFIDENT
    predicted = open_rows.select(
        *stated.columns, F.when(sure, F.col("weight_g") * unit_grams(F.col("unit"))).alias("mass_g"), F.when(sure, "predicted").otherwise("review").alias("mass_basis"),
        "unit", F.col("confidence").alias("unit_confidence"), (F.col("weight_g") * unit_grams(F.col("note_unit"))).alias("rule_g"),
    )
    mass = F.col("title_mass_g")
    told = stated.select("*", mass.alias("mass_g"), F.when(mass.isNotNull(), "title").alias("mass_basis"), F.lit(None).cast("string").alias("unit"), F.lit(1.0).alias("unit_confidence"), mass.alias("rule_g"))
    rows = told.unionByName(predicted).join(open_rates(fx_rates, provider), ["fx_rate_date", "currency_code"], "left")
    return rows.select("id", "source", "weight_g", "price", "price_usd", "mass_g", "mass_basis", "unit", "unit_confidence", "rule_g", "note_unit", "currency_code", (F.col("price") * F.col("currency_scale") * F.col("rate")).alias("usd"))


def wrong_values(converted: DataFrame) -> DataFrame:
    """(id, field): recorded grams or dollars that are off by more than 1 % from the converted ones.

    A mass is proposed where weight_g isn't the title's or the confidently predicted one, or its unit is under
    review; the exact rule then checks what is proposed. A recorded value counts as wrong only if there is
    something to hold against it; a price_usd without a price is wrong. Repeated rows give one case.
    """
    off = lambda given, true: F.abs(F.col(given) - F.col(true)) > OFF * F.abs(F.col(true))
    proposed = (F.col("mass_basis") == "review") | off("weight_g", "mass_g")
    mass = F.col("weight_g").isNotNull() & proposed & off("weight_g", "rule_g")
    usd = F.col("price_usd").isNotNull() & (F.col("price").isNull() | off("price_usd", "usd"))
    fields = F.array_compact(F.array(F.when(mass, F.lit("weight_g")), F.when(usd, F.lit("price_usd"))))
    return converted.select("id", F.explode(fields).alias("field")).distinct()


def basis_counts(converted: DataFrame) -> DataFrame:
    """(mass_basis, note_named, listings, against_rule): how the masses came about, by whether the notes name a unit other than grams."""
    against = F.abs(F.col("mass_g") - F.col("rule_g")) > OFF * F.abs(F.col("rule_g"))
    return converted.groupBy("mass_basis", (F.col("note_unit") != "g").alias("note_named")).agg(F.count(F.lit(1)).alias("listings"), F.count_if(against).alias("against_rule"))
