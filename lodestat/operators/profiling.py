"""Column profile: what each column holds and how it is written, from its value frequencies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.dates import CANDIDATE_DATE_FORMATS, date_mask, read_date
from lodestat.functions.numbers import parse_number
from lodestat.functions.text import (
    is_boolean_word,
    is_null_sentinel,
    normalize_text,
    recode_value,
    shown_pattern,
    trailing_unit,
    whole_pattern,
)
from lodestat.operators.frequencies import COLUMN, COUNT, VALUE, value_frequencies
from lodestat.session import materialized

# Fixed values of the type decision.
TYPE_COVERAGE = 0.95
CATEGORICAL_MAX_DISTINCT = 50
CATEGORICAL_MAX_RATIO = 0.10
IDENTIFIER_MIN_RATIO = 0.95
IDENTIFIER_MIN_ROWS = 30
PATTERNED_TYPES = ("entier", "decimal", "date", "identifiant")
OVERVIEW_COLUMNS = (
    "colonne",
    "type_reel",
    "type_semantique",
    "n_distinct",
    "n_distinct_normalise",
    "min",
    "max",
    "null_%",
)
_TYPED_STORAGE = (
    "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean", "date",
    "timestamp", "uint", "bool", "datetime", "timedelta",
)

def frequencies_once(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The value frequencies, computed once for the many branches that read them."""
    return materialized(value_frequencies(df, columns))


def _filled(freq: DataFrame) -> DataFrame:
    return freq.where(F.col(VALUE).isNotNull())


def _could_be_number(value: Column) -> Column:
    """Necessary for a value to read as a number once units are removed.

    Units hold no digit, comma or dot, so those all survive: at least one digit and at most one
    mark. Free text fails, which keeps its word endings from being gathered as units.
    """
    return value.rlike(r"\d") & ~value.rlike(r"(?s)[.,].*[.,]")


def detect_units(freq: DataFrame) -> DataFrame:
    """(colonne, unite): distinct non-numeric suffixes of the filled cells."""
    return (
        _filled(freq)
        .select(COLUMN, trailing_unit(F.col(VALUE)).alias("unite"))
        .where(F.col("unite").isNotNull())
        .distinct()
    )


def _numeric_units(freq: DataFrame) -> DataFrame:
    """(colonne, unites): sorted units of the columns that may be numeric, and only those."""
    likely = (
        _filled(freq)
        .groupBy(COLUMN)
        .agg((F.sum(F.when(_could_be_number(F.col(VALUE)), F.col(COUNT)).otherwise(0)) / F.sum(F.col(COUNT))).alias("_part"))
        .where(F.col("_part") >= TYPE_COVERAGE)
        .select(COLUMN)
    )
    units = (
        _filled(freq)
        .join(F.broadcast(likely), COLUMN, "left_semi")
        .groupBy(COLUMN)
        .agg(F.sort_array(F.collect_set(trailing_unit(F.col(VALUE)))).alias("unites"))
    )
    return units


def read_numbers(freq: DataFrame) -> DataFrame:
    """``freq`` of the columns that may be numeric, with ``nombre`` and the column's ``unites``."""
    return _filled(freq).join(F.broadcast(_numeric_units(freq)), COLUMN).withColumn(
        "nombre",
        F.coalesce(
            parse_number(F.col(VALUE)),
            F.when(_could_be_number(F.col(VALUE)), parse_number(F.col(VALUE), F.col("unites"))),
        ),
    )


def _bit(mask: Column, index: Column) -> Column:
    return F.getbit(mask, index) == 1


def _greedy_cover(masks: Column, size: int) -> Column:
    """Indices of the formats that together read every readable value, most useful first.

    ``masks`` is an array of (masque, n); ties go to the earlier format.
    """

    def gain(left: Column, index: Column) -> Column:
        return F.aggregate(
            left,
            F.lit(0).cast("long"),
            lambda total, m: total + F.when(_bit(m["masque"], index), m["n"]).otherwise(0),
        )

    def step(state: Column, _: Column) -> Column:
        gains = F.transform(
            F.sequence(F.lit(0), F.lit(size - 1)), lambda i: gain(state["left"], i)
        )
        best = F.array_position(gains, F.array_max(gains)).cast("int") - 1
        useful = F.array_max(gains) > 0
        left = F.filter(state["left"], lambda m: ~_bit(m["masque"], best))
        return F.struct(
            F.when(useful, left).otherwise(state["left"]).alias("left"),
            F.when(useful, F.concat(state["chosen"], F.array(best)))
            .otherwise(state["chosen"])
            .alias("chosen"),
        )

    start = F.struct(masks.alias("left"), F.array().cast("array<int>").alias("chosen"))
    rounds = F.sequence(F.lit(1), F.lit(size))
    return F.aggregate(rounds, start, step, lambda state: state["chosen"])


def date_formats(
    freq: DataFrame, candidates: Sequence[str] = CANDIDATE_DATE_FORMATS
) -> DataFrame:
    """(colonne, n_lisibles, n_dominant, choisis): formats needed to read each column's dates.

    Values are reduced to the set of formats that read them (at most 2^formats rows per column)
    before the greedy choice. ``choisis`` holds indices into ``candidates``.
    """
    masks = (
        _filled(freq)
        .groupBy(COLUMN, date_mask(F.col(VALUE), candidates).alias("masque"))
        .agg(F.sum(F.col(COUNT)).alias("n"))
        .where(F.col("masque") != 0)
    )
    gathered = masks.groupBy(COLUMN).agg(
        F.sum("n").alias("n_lisibles"),
        F.array_sort(F.collect_list(F.struct("masque", "n"))).alias("_masks"),
    )
    chosen = gathered.withColumn("choisis", _greedy_cover(F.col("_masks"), len(candidates)))
    dominant = F.aggregate(
        "_masks",
        F.lit(0).cast("long"),
        lambda total, m: total
        + F.when(_bit(m["masque"], F.col("choisis")[0]), m["n"]).otherwise(0),
    )
    return chosen.select(COLUMN, "n_lisibles", dominant.alias("n_dominant"), "choisis")


def format_names(
    indices: Column, candidates: Sequence[str] = CANDIDATE_DATE_FORMATS
) -> Column:
    names = F.array(*[F.lit(c) for c in candidates])
    return F.transform(indices, lambda i: names[i])


def read_by_formats(
    value: Column, chosen: Column, candidates: Sequence[str] = CANDIDATE_DATE_FORMATS
) -> Column:
    """Date read by the first of the chosen formats (an array of indices) that reads it."""
    readings = F.array(*[read_date(value, c) for c in candidates])
    found = F.filter(F.transform(chosen, lambda i: readings[i]), lambda d: d.isNotNull())
    return F.get(found, F.lit(0))


def detect_date_formats(
    df: DataFrame, columns: Sequence[str], candidates: Sequence[str] = CANDIDATE_DATE_FORMATS
) -> DataFrame:
    """(colonne, rang, format) of each column's minimal set of formats, most useful first."""
    found = date_formats(value_frequencies(df, columns), candidates)
    return found.select(
        COLUMN, F.posexplode(format_names(F.col("choisis"), candidates)).alias("rang", "format")
    )


def _facts(freq: DataFrame) -> DataFrame:
    """Everything the type decision needs, one row per column."""
    key = normalize_text(F.col(VALUE))
    keys = freq.groupBy(COLUMN, key.alias("cle")).agg(
        F.sum(F.col(COUNT)).alias("n"),
        F.max(F.col(COUNT)).alias("n_majoritaire"),
        F.count(F.col(VALUE)).alias("n_ecritures"),
        F.bool_or(F.col(VALUE).rlike(r"[.,]\d")).alias("marque"),
        F.bool_or(F.col(VALUE).contains(",")).alias("virgule"),
        F.sum(F.when(F.col(VALUE).rlike(r"^[+-]?\d+$"), F.col(COUNT)).otherwise(0)).alias("n_entier"),
        F.sum(F.when(F.col(VALUE).rlike(r"^[+-]?\d+(\.\d+)?$"), F.col(COUNT)).otherwise(0)).alias("n_decimal"),
    )
    filled = F.col("cle").isNotNull()
    base = keys.groupBy(COLUMN).agg(
        F.sum("n").alias("n_lignes"),
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("n_remplies"),
        F.coalesce(F.sum("n_ecritures"), F.lit(0)).alias("n_distinct"),
        F.count("cle").alias("n_distinct_normalise"),
        F.coalesce(F.sum(F.when(filled, F.col("n_majoritaire"))), F.lit(0)).alias("n_majoritaire"),
        F.bool_and(is_boolean_word(F.col("cle"))).alias("booleen"),
        F.bool_or("marque").alias("marque"),
        F.bool_or("virgule").alias("virgule"),
        F.sum("n_entier").alias("n_entier"),
        F.sum("n_decimal").alias("n_decimal"),
        F.array_sort(F.collect_set(F.when(is_null_sentinel(F.col("cle")), F.col("cle")))).alias(
            "marqueurs"
        ),
    )
    numbers = (
        read_numbers(freq)
        .groupBy(COLUMN)
        .agg(
            F.sum(F.when(F.col("nombre").isNotNull(), F.col(COUNT)).otherwise(0)).alias("n_nombres"),
            F.min("nombre").alias("nombre_min"),
            F.max("nombre").alias("nombre_max"),
            F.first("unites").alias("unites"),
        )
    )
    # One row per column in all three: the joins are broadcasts of a few rows.
    facts = (
        base.join(F.broadcast(numbers), COLUMN, "left")
        .join(F.broadcast(date_formats(freq)), COLUMN, "left")
    )
    n = F.col("n_remplies")
    ratio = F.col("n_distinct") / n
    kind = (
        F.when(n == 0, "vide")
        .when(F.col("n_distinct") == 1, "constant")
        .when(F.col("booleen"), "booleen")
        .when(
            (ratio >= IDENTIFIER_MIN_RATIO) & (n >= IDENTIFIER_MIN_ROWS) & ~F.col("marque"),
            "identifiant",
        )
        .when(
            F.coalesce("n_nombres", F.lit(0)) / n >= TYPE_COVERAGE,
            F.when(F.col("marque"), "decimal").otherwise("entier"),
        )
        .when(F.coalesce("n_lisibles", F.lit(0)) / n >= TYPE_COVERAGE, "date")
        .when(
            (F.col("n_distinct") <= CATEGORICAL_MAX_DISTINCT) & (ratio <= CATEGORICAL_MAX_RATIO),
            "categoriel",
        )
        .otherwise("texte")
    )
    return facts.withColumn("type_semantique", kind)


def infer_semantic_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(colonne, type_semantique): what each column stands for, whatever its storage type."""
    return _facts(frequencies_once(df, columns)).select(COLUMN, "type_semantique")


def _conform_share(kind: Column) -> Column:
    """Share of the filled cells written in the canonical form of the column's type."""
    n = F.col("n_remplies")
    return (
        F.when(n == 0, 0.0)
        .when(kind == "entier", F.col("n_entier") / n)
        .when(kind == "decimal", F.col("n_decimal") / n)
        .when(kind == "date", F.col("n_dominant") / n)
        .otherwise(F.col("n_majoritaire") / n)
    )


def conformity(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(colonne, type_semantique, taux_conforme)."""
    facts = _facts(frequencies_once(df, columns))
    return facts.select(
        COLUMN, "type_semantique", _conform_share(F.col("type_semantique")).alias("taux_conforme")
    )


def _written_decimal(x: Column) -> Column:
    """A double as Python writes it, without exponent in the usual range."""
    plain = (x == 0) | (F.abs(x) >= 1e-3) & (F.abs(x) < 1e7)
    exact = F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"0+$", "")
    return F.when(plain, x.cast("string")).otherwise(F.regexp_replace(exact, r"\.$", ".0"))


def _written_date(d: Column) -> Column:
    return F.regexp_replace(F.date_format(d, "yyyy-MM-dd HH:mm:ss"), " 00:00:00$", "")


def _date_extent(freq: DataFrame, facts: DataFrame) -> DataFrame:
    dated = facts.where(F.col("type_semantique") == "date").select(COLUMN, "choisis")
    read = _filled(freq).join(F.broadcast(dated), COLUMN).select(
        COLUMN, read_by_formats(F.col(VALUE), F.col("choisis")).alias("d")
    )
    return read.groupBy(COLUMN).agg(F.min("d").alias("date_min"), F.max("d").alias("date_max"))


def _bounds(kind: Column, end: str) -> Column:
    number = F.col(f"nombre_{end}")
    return (
        F.when(kind == "entier", F.format_string("%.0f", number))
        .when(kind == "decimal", _written_decimal(number))
        .when(kind == "date", _written_date(F.col(f"date_{end}")))
    )


def extent(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(colonne, min, max): bounds read on the magnitude, written canonically; NULL if unordered."""
    freq = frequencies_once(df, columns)
    facts = _facts_once(freq)
    kind = F.col("type_semantique")
    return facts.join(F.broadcast(_date_extent(freq, facts)), COLUMN, "left").select(
        COLUMN, _bounds(kind, "min").alias("min"), _bounds(kind, "max").alias("max")
    )


def _remarks(kind: Column) -> Column:
    numeric = kind.isin("entier", "decimal")
    quoted = F.array_join(F.transform("unites", lambda u: F.concat(F.lit("« "), u, F.lit(" »"))), ", ")
    units = F.when(numeric & (F.size("unites") > 0), F.concat(F.lit("unité(s) collée(s) : "), quoted))
    comma = F.when(numeric & F.col("virgule"), F.lit("virgule décimale"))
    mixed = F.when(
        (kind == "date") & (F.size("choisis") > 1),
        F.concat(
            F.size("choisis").cast("string"),
            F.lit(" formats mêlés : "),
            F.array_join(format_names(F.col("choisis")), ", "),
        ),
    )
    written = F.when(
        F.size("marqueurs") > 0,
        F.concat(F.lit("marqueur(s) d'absence écrit(s) : "), F.array_join("marqueurs", ", ")),
    )
    return F.concat_ws(" ; ", units, comma, mixed, written)


def remarks(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(colonne, remarques): glued units, decimal comma, mixed date formats, written absences."""
    facts = _facts(frequencies_once(df, columns))
    return facts.select(COLUMN, _remarks(F.col("type_semantique")).alias("remarques"))


def _patterns(freq: DataFrame) -> DataFrame:
    """(colonne, forme, motif, n, exemple): how often each whole shape occurs; ``motif`` is for reading."""
    return (
        _filled(freq)
        .groupBy(COLUMN, whole_pattern(F.col(VALUE)).alias("forme"))
        .agg(F.sum(F.col(COUNT)).alias("n"), F.min(F.col(VALUE)).alias("exemple"))
        .withColumn("motif", shown_pattern(F.col("forme")))
    )


def _dominant(patterns: DataFrame) -> DataFrame:
    top = F.min(F.struct((-F.col("n")).alias("k"), F.col("forme"), F.col("motif")))
    return patterns.groupBy(COLUMN).agg(
        F.count(F.lit(1)).alias("n_motifs"), top.alias("_top"), F.sum("n").alias("_n")
    ).select(
        COLUMN,
        F.col("_top.motif").alias("motif_dominant"),
        (-100 * F.col("_top.k") / F.col("_n")).alias("couverture_motif_%"),
        "n_motifs",
    )


def _stored_as_text(dtype: Column) -> Column:
    return ~dtype.rlike("^(" + "|".join(_TYPED_STORAGE) + ")")


def _facts_once(freq: DataFrame) -> DataFrame:
    """The facts of each column, one row per column, kept for the branches that read them."""
    return materialized(_facts(freq))


def _with_storage(facts: DataFrame, dtypes: Mapping[str, str]) -> DataFrame:
    pairs = [F.lit(x) for pair in dtypes.items() for x in pair]
    known = F.create_map(*pairs)[F.col(COLUMN)] if pairs else F.lit(None).cast("string")
    return facts.withColumn("type_reel", F.coalesce(known, F.lit("")))


def _patterned(facts: DataFrame) -> DataFrame:
    """Columns whose patterns mean something: left as text, of a type with a canonical form."""
    return facts.where(
        F.col("type_semantique").isin(*PATTERNED_TYPES) & _stored_as_text(F.col("type_reel"))
    ).select(COLUMN)


def dominant_pattern(
    df: DataFrame, columns: Sequence[str] | None = None, dtypes: Mapping[str, str] | None = None
) -> DataFrame:
    """(colonne, motif_dominant, couverture_motif_%, n_motifs) where patterns are informative."""
    freq = frequencies_once(df, columns)
    facts = _with_storage(_facts_once(freq), dtypes or {})
    kept = freq.join(F.broadcast(_patterned(facts)), COLUMN, "left_semi")
    return _dominant(_patterns(kept))


def _examples(freq: DataFrame) -> DataFrame:
    """(colonne, exemples): the three most frequent values, ties by the alphabet."""
    order = Window.partitionBy(COLUMN).orderBy(F.desc(COUNT), VALUE)
    # The rank filter is pushed below the shuffle: each task sends three rows per column.
    top = _filled(freq).withColumn("_rang", F.row_number().over(order)).where("_rang <= 3")
    listed = F.array_sort(F.collect_list(F.struct("_rang", VALUE)))
    return top.groupBy(COLUMN).agg(
        F.array_join(F.transform(listed, lambda s: s[VALUE]), " | ").alias("exemples")
    )


def profile_columns(
    df: DataFrame, columns: Sequence[str] | None = None, dtypes: Mapping[str, str] | None = None
) -> DataFrame:
    """The fourteen indicators, one row per column; an indicator that does not apply is NULL."""
    freq = frequencies_once(df, columns)
    facts = _with_storage(_facts_once(freq), dtypes or {})
    kept = freq.join(F.broadcast(_patterned(facts)), COLUMN, "left_semi")
    kind = F.col("type_semantique")
    n = F.col("n_remplies")
    return (
        facts.join(F.broadcast(_dominant(_patterns(kept))), COLUMN, "left")
        .join(F.broadcast(_date_extent(freq, facts)), COLUMN, "left")
        .join(F.broadcast(_examples(freq)), COLUMN, "left")
        .select(
            COLUMN,
            "type_reel",
            "type_semantique",
            "motif_dominant",
            "couverture_motif_%",
            "n_motifs",
            "n_distinct",
            "n_distinct_normalise",
            _bounds(kind, "min").alias("min"),
            _bounds(kind, "max").alias("max"),
            (100 * (1 - n / F.col("n_lignes"))).alias("null_%"),
            (100 * (1 - _conform_share(kind))).alias("non_conforme_%"),
            F.coalesce("exemples", F.lit("")).alias("exemples"),
            _remarks(kind).alias("remarques"),
        )
    )


def profile_overview(profile: DataFrame) -> DataFrame:
    """The eight indicators read on screen."""
    return profile.select(*[f"`{c}`" for c in OVERVIEW_COLUMNS])


def profile_flags(profile: DataFrame) -> DataFrame:
    """(colonne, constante, nonconforme, manquants)."""
    return profile.select(
        COLUMN,
        (F.col("n_distinct") == 1).alias("constante"),
        (F.col("non_conforme_%") > 0).alias("nonconforme"),
        (F.col("null_%") > 0).alias("manquants"),
    )


def boolean_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(colonne, booleen): whether every filled value is a spelling of a boolean."""
    freq = value_frequencies(df, columns)
    return freq.groupBy(COLUMN).agg(
        F.coalesce(F.bool_and(is_boolean_word(normalize_text(F.col(VALUE)))), F.lit(False)).alias("booleen")
    )


def null_sentinels(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(colonne, marqueur, n): absences written in full, reported and never converted."""
    freq = value_frequencies(df, columns)
    key = normalize_text(F.col(VALUE))
    return (
        freq.select(COLUMN, key.alias("marqueur"), COUNT)
        .where(is_null_sentinel(F.col("marqueur")))
        .groupBy(COLUMN, "marqueur")
        .agg(F.sum(COUNT).alias("n"))
    )


def _shares(groups: DataFrame, count: str) -> DataFrame:
    """Groups with the number of groups of their column, as ``count``, and their share of it in %."""
    totals = groups.groupBy(COLUMN).agg(F.count(F.lit(1)).alias(count), F.sum("n").alias("_total"))
    return groups.join(F.broadcast(totals), COLUMN).withColumn(  # one row per column
        "part_%", 100 * F.col("n") / F.col("_total")
    )


def modality_breakdown(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(colonne, modalite, n, part_%, n_modalites, ecriture, n_ecriture), one row per spelling.

    Every column is listed, however many modalities it has: ``n_modalites`` says which are worth reading.
    """
    keyed = _filled(frequencies_once(df, columns)).withColumn("modalite", normalize_text(F.col(VALUE)))
    counts = _shares(keyed.groupBy(COLUMN, "modalite").agg(F.sum(COUNT).alias("n")), "n_modalites")
    spellings = keyed.select(COLUMN, "modalite", F.col(VALUE).alias("ecriture"), F.col(COUNT).alias("n_ecriture"))
    return spellings.join(counts, [COLUMN, "modalite"]).select(
        COLUMN, "modalite", "n", "part_%", "n_modalites", "ecriture", "n_ecriture"
    )


def pattern_breakdown(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(colonne, motif, n, part_%, n_motifs, exemple), one row per whole shape, of every column."""
    return _shares(_patterns(value_frequencies(df, columns)), "n_motifs").select(
        COLUMN, "motif", "n", "part_%", "n_motifs", "exemple"
    )


def modality_reduction(
    df: DataFrame, vocabulary: Mapping[str, Mapping[str, Sequence[str]]], columns: Sequence[str]
) -> DataFrame:
    """(colonne, n_brut, n_normalise, n_recode): modalities left after each step."""
    key = normalize_text(F.col(VALUE))
    recoded = F.col("cle")
    for column in columns:
        if column in vocabulary:
            recoded = F.when(
                F.col(COLUMN) == column, recode_value(F.col("cle"), vocabulary[column])
            ).otherwise(recoded)
    keys = (
        _filled(value_frequencies(df, columns))
        .groupBy(COLUMN, key.alias("cle"))
        .agg(F.count(F.lit(1)).alias("n_brut"))
    )
    return keys.withColumn("recode", recoded).groupBy(COLUMN).agg(
        F.sum("n_brut").alias("n_brut"),
        F.count(F.lit(1)).alias("n_normalise"),
        F.count_distinct("recode").alias("n_recode"),
    )
