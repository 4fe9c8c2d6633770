"""Registered queries: sources, scalar functions, profiling, preparation, integrity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestat import functions as L
from lodestat.operators import integrity, prepare, profiling
from lodestat.operators.frequencies import value_frequencies
from lodestat.plans.registry import (
    MESSY_COLUMNS,
    SQL_HOLES,
    SQL_MESSY,
    R,
    holes,
    messy,
    register,
    scratch,
    sql_key,
    table,
)
from lodestat.sources import files, layers

VOCABULARY = {
    "filiere": {"general": ("gen", "gene", "general"), "lettres": ("lettres modernes",)},
    "boursier": {"oui": ("o", "oui", "1"), "non": ("n", "non")},
}
_SQL_RECODE_FILIERE = (
    "CASE WHEN {k} IN ('gen','gene','general') THEN 'general' "
    "WHEN {k} = 'lettres modernes' THEN 'lettres' ELSE {k} END"
)
_SQL_RECODE_BOURSIER = (
    "CASE WHEN {k} IN ('o','oui','1') THEN 'oui' WHEN {k} IN ('n','non') THEN 'non' ELSE {k} END"
)
_DAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")
_SQL_DAY = (
    "['lundi','mardi','mercredi','jeudi','vendredi','samedi','dimanche'][isodow(o_orderdate)]"
)
_SQL_NUMBER = (
    "try_cast(replace(regexp_replace(regexp_replace({c}, 'km|n/a', '', 'gi'), '\\s', '', 'g'), ',', '.') AS DOUBLE)"
)
_SQL_DATE = (
    "coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%d/%m/%Y'), try_strptime({c}, '%d %b %Y'))"
)
_LONG = ", ".join(MESSY_COLUMNS)
# Value frequencies of the hand-typed table, blanks as NULL.
SQL_FREQ = (
    f"WITH {SQL_MESSY}, long AS (SELECT colonne, v FROM messy UNPIVOT INCLUDE NULLS (v FOR colonne IN ({_LONG}))), "
    "freq AS (SELECT colonne, CASE WHEN trim(v) = '' THEN NULL ELSE v END AS valeur, count(*) AS n "
    "FROM long GROUP BY ALL), filled AS (SELECT * FROM freq WHERE valeur IS NOT NULL), "
    f"keyed AS (SELECT *, {sql_key('valeur')} AS cle FROM filled)"
)


# --- sources and sinks ------------------------------------------------------------------------


def _written(spark, folder, columns, sep=";"):
    path = scratch(spark)
    messy(spark, folder).select(*columns).write.csv(
        path, header=True, sep=sep, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return path


@register(
    "read_text_table",
    f"WITH {SQL_MESSY} SELECT ident, distance, jour, nullif(filiere, '') AS filiere FROM messy",
)
def _(spark, folder):
    path = _written(spark, folder, ["ident", "distance", "jour", "filiere"])
    return files.read_text_table(spark, path, ";")


@register(
    "sniff_files",
    "WITH l AS (SELECT o_orderpriority AS p, strlen(concat(o_orderkey, ';\"', o_custkey, ',é,', o_orderstatus, '\"')) + 1 AS k FROM orders) "
    "SELECT CASE p WHEN '1-URGENT' THEN 'utf-8-sig' ELSE 'utf-8' END AS encoding, p = '1-URGENT' AS has_bom, ';' AS delimiter, "
    "CAST(sum(k) + CASE p WHEN '1-URGENT' THEN 3 ELSE 0 END AS BIGINT) AS size, p AS fichier FROM l GROUP BY p",
)
def _(spark, folder):
    path = scratch(spark)
    line = F.concat("o_orderkey", F.lit(';"'), "o_custkey", F.lit(",é,"), "o_orderstatus", F.lit('"'))
    rows = table(spark, folder, "orders").select("o_orderpriority", "o_orderkey", line.alias("value"))
    first = F.col("o_orderkey") == F.min("o_orderkey").over(Window.partitionBy("o_orderpriority"))
    marked = F.when(first & (F.col("o_orderpriority") == "1-URGENT"), F.concat(F.lit("\ufeff"), "value")).otherwise(F.col("value"))
    rows.select("o_orderpriority", F.col("o_orderkey").alias("k"), marked.alias("value")).repartition(
        5, "o_orderpriority"
    ).sortWithinPartitions("o_orderpriority", "k").select("o_orderpriority", "value").write.partitionBy(
        "o_orderpriority"
    ).text(path)
    found = files.sniff_files(spark, f"{path}/*/*.txt")
    return found.select(
        "encoding", "has_bom", "delimiter", "size", F.url_decode(F.regexp_extract("path", "o_orderpriority=([^/]+)/", 1)).alias("fichier")
    )


@register(
    "file_facts",
    "WITH r AS (SELECT lineitem.*, count(*) AS k FROM lineitem GROUP BY ALL) "
    "SELECT CAST(sum(k) AS BIGINT) AS n_lignes, (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE lineitem)) AS n_colonnes, CAST(sum(k) - count(*) AS BIGINT) AS n_lignes_en_double FROM r",
)
def _(spark, folder):
    return files.table_facts(table(spark, folder, "lineitem"))


@register(
    "inferred_types",
    "SELECT colonne, CASE WHEN colonne IN ('o_orderkey', 'o_custkey') AND (SELECT max(greatest(o_orderkey, o_custkey)) FROM orders) < 2147483648 THEN 'int' "
    "WHEN colonne = 'o_totalprice' THEN 'double' WHEN colonne = 'o_orderdate' THEN 'timestamp' ELSE 'string' END AS type_reel "
    "FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS colonne)",
)
def _(spark, folder):
    path = scratch(spark)
    table(spark, folder, "orders").write.csv(path, header=True)
    return files.inferred_types(spark, path)


@register(
    "write_layers",
    f"WITH {SQL_MESSY}, s AS (SELECT DISTINCT {sql_key('filiere')} AS filiere, {sql_key('annee')} AS annee FROM messy) "
    "SELECT 'bronze' AS couche, (SELECT count(*) FROM messy) AS n UNION ALL SELECT 'silver', (SELECT count(*) FROM s) "
    "UNION ALL SELECT 'gold', (SELECT count(*) FROM s)",
)
def _(spark, folder):
    source, root = scratch(spark), scratch(spark)
    raw = messy(spark, folder).select("filiere", "annee")
    raw.withColumn("l", F.concat_ws(";", "filiere", "annee")).select("l").write.text(source)
    silver = prepare.transform(raw, {})
    layers.write_layers(spark, source, silver, prepare.build_gold(silver, ["annee"], {}), root)
    parts = [
        spark.read.parquet(f"{root}/{name}").select(F.lit(name).alias("couche"), lines.cast("bigint").alias("k"))
        for name, lines in (("bronze", F.col("lignes")), ("silver", F.lit(1)), ("gold", F.lit(1)))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("couche").agg(F.sum("k").alias("n"))


@register(
    "received_bytes",
    f"WITH {SQL_MESSY}, l AS (SELECT concat_ws(';', filiere, distance, commentaire) AS l FROM messy) "
    "SELECT count(*) AS lignes, CAST(sum(octet_length(encode(l)) + 1) AS BIGINT) AS octets, CAST(0 AS BIGINT) AS abimees FROM l",
)
def _(spark, folder):
    """Lines and bytes of the ranges of files as they were received, and ranges without their checksum."""
    source, root = scratch(spark), scratch(spark)
    messy(spark, folder).select(F.concat_ws(";", "filiere", "distance", "commentaire").alias("l")).write.text(source)
    layers.received_ranges(spark, source, 1 << 16).write.parquet(root)
    ranges = spark.read.parquet(root)
    damaged = layers.damaged_ranges(ranges).count()
    return ranges.agg(F.sum("lignes").alias("lignes"), F.sum("octets").alias("octets"), F.lit(damaged).cast("bigint").alias("abimees"))


@register(
    "table_fingerprint",
    "SELECT count(*) AS n_lignes, TRUE AS sans_ordre, FALSE AS sans_une_ligne, FALSE AS valeur_changee, 12 AS longueur FROM orders",
)
def _(spark, folder):
    """The fingerprint of all orders against that of reordered, shortened and altered ones."""
    orders = table(spark, folder, "orders")
    last = orders.agg(F.max("o_orderkey")).scalar()
    variants = {
        "a": orders,
        "sans_ordre": orders.repartition(7, "o_custkey").sortWithinPartitions(F.desc("o_totalprice")),
        "sans_une_ligne": orders.where(F.col("o_orderkey") != last),
        "valeur_changee": orders.withColumn(
            "o_totalprice", F.when(F.col("o_orderkey") == last, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
        ),
    }
    parts = [prepare.table_fingerprint(df).withColumn("version", F.lit(name)) for name, df in variants.items()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    pick = lambda name, c: F.max(F.when(F.col("version") == name, F.col(c)))
    own = pick("a", "empreinte")
    return every.agg(
        pick("a", "n_lignes").alias("n_lignes"),
        *[(pick(name, "empreinte") == own).alias(name) for name in list(variants)[1:]],
        F.length(own).cast("int").alias("longueur"),
    )


@register(
    "archive_run",
    "SELECT r AS run, CAST((SELECT count(*) FROM orders) AS DOUBLE) AS lignes, v AS version FROM "
    "(VALUES ('20260101T000000_v1.0', '1.0'), ('20260102T000000_v1.1', '1.1')) t(r, v)",
)
def _(spark, folder):
    root = scratch(spark)
    rows = table(spark, folder, "orders").count()
    for stamp, version in (("20260101T000000", "1.0"), ("20260102T000000", "1.1")):
        record = layers.run_record(spark, {"version": version, "lignes": rows})
        layers.archive_run(record, root, stamp, version)
    return layers.history(spark, root).select("run", "lignes", F.col("version").cast("string"))


@register(
    "rollback_run",
    "SELECT '20260101T000000_v1.0' AS run, CAST((SELECT count(*) FROM orders) AS DOUBLE) AS lignes",
)
def _(spark, folder):
    """The current run after a second one was archived and taken back."""
    root, orders = scratch(spark), table(spark, folder, "orders").count()
    items = table(spark, folder, "lineitem").count()
    for stamp, version, rows in (("20260101T000000", "1.0", orders), ("20260102T000000", "1.1", items)):
        layers.archive_run(layers.run_record(spark, {"version": version, "lignes": rows}), root, stamp, version)
    layers.rollback(spark, root)
    return layers.current_run(spark, root).select("run", "lignes")


# --- scalar functions -------------------------------------------------------------------------


@register(
    "blank_to_null",
    f"WITH {SQL_MESSY} SELECT o_orderkey, CASE WHEN trim(distance) = '' THEN NULL ELSE distance END AS distance, "
    "nullif(filiere, '') AS filiere FROM messy",
)
def _(spark, folder):
    return messy(spark, folder).select(
        "o_orderkey",
        L.blank_to_null(F.col("distance")).alias("distance"),
        L.blank_to_null(F.col("filiere")).alias("filiere"),
    )


@register(
    "normalize_text",
    "SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g')) AS cle FROM documents",
)
def _(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", L.normalize_text(F.col("text")).alias("cle")
    )


@register(
    "parse_number",
    f"WITH {SQL_MESSY} SELECT o_orderkey, {_SQL_NUMBER.format(c='distance')} AS nombre FROM messy",
)
def _(spark, folder):
    return messy(spark, folder).select(
        "o_orderkey", L.parse_number(F.col("distance"), ["km"]).alias("nombre")
    )


@register(
    "parse_date",
    f"WITH {SQL_MESSY} SELECT o_orderkey, strftime({_SQL_DATE.format(c='jour')}, '%Y-%m-%d') AS jour FROM messy",
)
def _(spark, folder):
    read = L.parse_date(F.col("jour"), ["%Y-%m-%d", "%d/%m/%Y", "%d %b %Y"])
    return messy(spark, folder).select("o_orderkey", F.date_format(read, "yyyy-MM-dd").alias("jour"))


@register(
    "detect_units",
    SQL_FREQ + " SELECT DISTINCT colonne, regexp_extract(valeur, '([^\\d\\s,.]+)\\s*$', 1) AS unite FROM filled "
    "WHERE regexp_extract(valeur, '([^\\d\\s,.]+)\\s*$', 1) <> ''",
)
def _(spark, folder):
    return profiling.detect_units(value_frequencies(messy(spark, folder), MESSY_COLUMNS))


@register(
    "detect_date_formats",
    f"WITH {SQL_MESSY}, c AS (SELECT CASE WHEN try_strptime(jour, '%Y-%m-%d') IS NOT NULL THEN '%Y-%m-%d' "
    "WHEN try_strptime(jour, '%d/%m/%Y') IS NOT NULL THEN '%d/%m/%Y' ELSE '%d %b %Y' END AS format, "
    "count(*) AS n FROM messy GROUP BY 1) SELECT 'jour' AS colonne, "
    "CAST(row_number() OVER (ORDER BY n DESC, CASE format WHEN '%Y-%m-%d' THEN 0 WHEN '%d/%m/%Y' THEN 1 ELSE 2 END) - 1 AS INTEGER) AS rang, format FROM c",
)
def _(spark, folder):
    return profiling.detect_date_formats(messy(spark, folder), ["jour"])


@register(
    "recode",
    f"WITH {SQL_MESSY} SELECT o_orderkey, {_SQL_RECODE_FILIERE.format(k=sql_key('filiere'))} AS filiere, "
    f"{_SQL_RECODE_BOURSIER.format(k=sql_key('boursier'))} AS boursier FROM messy",
)
def _(spark, folder):
    text = messy(spark, folder).select("o_orderkey", "filiere", "boursier")
    keyed = text.withColumns(
        {c: L.normalize_text(F.col(c)) for c in ("filiere", "boursier")}
    )
    return prepare.recode(keyed, VOCABULARY)[0]


@register(
    "find_null_sentinels",
    SQL_FREQ + " SELECT colonne, cle AS marqueur, CAST(sum(n) AS BIGINT) AS n FROM keyed "
    "WHERE cle IN ('na','n/a','nan','null','none','nc','n.c.','-','?','.') GROUP BY ALL",
)
def _(spark, folder):
    return profiling.null_sentinels(messy(spark, folder), MESSY_COLUMNS)


@register(
    "is_boolean_column",
    SQL_FREQ + " SELECT colonne, coalesce(bool_and(cle IN ('0','1','oui','non','o','n','true','false','vrai','faux','yes','no','y','t','f')), FALSE) AS booleen "
    "FROM (SELECT colonne, cle FROM keyed UNION ALL SELECT DISTINCT colonne, NULL FROM freq) GROUP BY colonne",
)
def _(spark, folder):
    return profiling.boolean_columns(messy(spark, folder), MESSY_COLUMNS)


@register(
    "safe_ratio",
    f"SELECT l_orderkey, l_linenumber, {R('CASE WHEN l_linenumber - 3 > 0 THEN l_quantity / (l_linenumber - 3) END')} AS ratio, l_partkey, l_suppkey FROM lineitem",
)
def _(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        L.safe_ratio(F.col("l_quantity"), F.col("l_linenumber") - 3).alias("ratio"),
        "l_partkey",
        "l_suppkey",
    )


@register(
    "clip",
    f"SELECT l_orderkey, l_partkey, {R('greatest(least(l_quantity - 10, 20), 0)')} AS v FROM lineitem",
)
def _(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", L.clip(F.col("l_quantity") - 10, 0.0, 20.0).alias("v")
    )


@register("weekday_name", f"SELECT o_orderkey, {_SQL_DAY} AS jour FROM orders")
def _(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", L.weekday_name(F.col("o_orderdate"), _DAYS).alias("jour")
    )


@register(
    "agreement_rate",
    f"SELECT {R(f'avg(CASE WHEN ({_SQL_DAY}) = (CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN chr(108) ELSE ({_SQL_DAY}) END) THEN 1.0 WHEN o_orderkey % 10 = 0 THEN NULL ELSE 0.0 END)')} AS taux FROM orders",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    derived = L.weekday_name(F.col("o_orderdate"), _DAYS)
    stored = (
        F.when(F.col("o_orderkey") % 10 == 0, F.lit(None).cast("string"))
        .when(F.col("o_orderkey") % 3 == 0, "l")
        .otherwise(derived)
    )
    return orders.agg(L.agreement_rate(stored, derived).alias("taux"))


@register(
    "as_modality",
    f"WITH {SQL_HOLES} SELECT l_orderkey, l_linenumber, coalesce(f, '(manquant)') AS f, coalesce(CAST(y AS VARCHAR), '(manquant)') AS y FROM holes",
)
def _(spark, folder):
    return holes(spark, folder).select(
        "l_orderkey",
        "l_linenumber",
        L.as_modality(F.col("f")).alias("f"),
        L.as_modality(F.col("y")).alias("y"),
    )


@register("sigmoid", f"SELECT l_orderkey, l_partkey, {R('1 / (1 + exp(-(l_quantity - 25) / 10))')} AS p FROM lineitem")
def _(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", L.sigmoid((F.col("l_quantity") - 25) / 10).alias("p")
    )


# --- profiling --------------------------------------------------------------------------------

_SQL_FACTS = (
    SQL_FREQ
    + f""", base AS (
  SELECT f.colonne, CAST(sum(n) AS BIGINT) AS lignes, CAST(coalesce(sum(n) FILTER (valeur IS NOT NULL), 0) AS BIGINT) AS remplies,
         count(valeur) AS n_distinct FROM freq f GROUP BY 1),
num AS (SELECT colonne, sum(n) FILTER ({_SQL_NUMBER.format(c='valeur')} IS NOT NULL) AS n_num,
         min({_SQL_NUMBER.format(c='valeur')}) AS num_min, max({_SQL_NUMBER.format(c='valeur')}) AS num_max,
         sum(n) FILTER ({_SQL_DATE.format(c='valeur')} IS NOT NULL) AS n_date,
         min({_SQL_DATE.format(c='valeur')}) AS d_min, max({_SQL_DATE.format(c='valeur')}) AS d_max,
         sum(n) FILTER (try_strptime(valeur, '%Y-%m-%d') IS NOT NULL) AS n_iso,
         sum(n) FILTER (regexp_full_match(valeur, '[+-]?\\d+')) AS n_int,
         sum(n) FILTER (regexp_full_match(valeur, '[+-]?\\d+(\\.\\d+)?')) AS n_dec,
         bool_or(regexp_matches(valeur, '[.,]\\d')) AS marque,
         bool_and(cle IN ('0','1','oui','non','o','n','true','false','vrai','faux','yes','no','y','t','f')) AS bool
  FROM keyed GROUP BY 1),
maj AS (SELECT colonne, sum(m) AS n_maj, count(*) AS n_cle FROM (SELECT colonne, cle, max(n) AS m FROM keyed GROUP BY ALL) GROUP BY 1),
typed AS (SELECT b.*, num.* EXCLUDE (colonne), coalesce(n_cle, 0) AS n_distinct_normalise, n_maj,
  CASE WHEN remplies = 0 THEN 'vide' WHEN n_distinct = 1 THEN 'constant' WHEN bool THEN 'booleen'
       WHEN n_distinct / remplies >= 0.95 AND remplies >= 30 AND NOT marque THEN 'identifiant'
       WHEN coalesce(n_num, 0) / remplies >= 0.95 THEN CASE WHEN marque THEN 'decimal' ELSE 'entier' END
       WHEN coalesce(n_date, 0) / remplies >= 0.95 THEN 'date'
       WHEN n_distinct <= 50 AND n_distinct / remplies <= 0.10 THEN 'categoriel' ELSE 'texte' END AS type_semantique
  FROM base b LEFT JOIN num USING (colonne) LEFT JOIN maj USING (colonne)),
rated AS (SELECT *, CASE WHEN remplies = 0 THEN 0.0 WHEN type_semantique = 'entier' THEN coalesce(n_int, 0) / remplies
   WHEN type_semantique = 'decimal' THEN coalesce(n_dec, 0) / remplies
   WHEN type_semantique = 'date' THEN n_iso / remplies ELSE n_maj / remplies END AS taux_conforme,
   CASE WHEN type_semantique = 'entier' THEN printf('%.0f', num_min) WHEN type_semantique = 'decimal' THEN CAST(num_min AS VARCHAR)
        WHEN type_semantique = 'date' THEN strftime(d_min, '%Y-%m-%d') END AS "min",
   CASE WHEN type_semantique = 'entier' THEN printf('%.0f', num_max) WHEN type_semantique = 'decimal' THEN CAST(num_max AS VARCHAR)
        WHEN type_semantique = 'date' THEN strftime(d_max, '%Y-%m-%d') END AS "max" FROM typed)"""
)


@register(
    "value_frequencies",
    SQL_FREQ + " SELECT colonne, valeur, n FROM freq",
)
def _(spark, folder):
    return value_frequencies(messy(spark, folder), MESSY_COLUMNS)


@register("infer_semantic_type", _SQL_FACTS + " SELECT colonne, type_semantique FROM typed")
def _(spark, folder):
    return profiling.infer_semantic_types(messy(spark, folder), MESSY_COLUMNS)


@register(
    "conformity_rate",
    _SQL_FACTS + f" SELECT colonne, type_semantique, {R('taux_conforme')} AS taux_conforme FROM rated",
)
def _(spark, folder):
    return profiling.conformity(messy(spark, folder), MESSY_COLUMNS)


@register("extent", _SQL_FACTS + ' SELECT colonne, "min", "max" FROM rated')
def _(spark, folder):
    return profiling.extent(messy(spark, folder), MESSY_COLUMNS)


_SQL_REMARKS = (
    "CASE colonne WHEN 'distance' THEN 'unité(s) collée(s) : « km », « n/a » ; virgule décimale ; marqueur(s) d''absence écrit(s) : n/a' "
    "WHEN 'jour' THEN '3 formats mêlés : %Y-%m-%d, ' || "
    "(SELECT CASE WHEN count(*) FILTER (o_orderkey % 5 = 0) >= count(*) FILTER (o_orderkey % 5 = 1) THEN '%d/%m/%Y, %d %b %Y' ELSE '%d %b %Y, %d/%m/%Y' END FROM orders) "
    "ELSE '' END"
)


@register("remarks", _SQL_FACTS + f" SELECT colonne, {_SQL_REMARKS} AS remarques FROM typed")
def _(spark, folder):
    return profiling.remarks(messy(spark, folder), MESSY_COLUMNS)


# Patterns as runs of one class, spelled with their length.
_SQL_RUNS = (
    "(SELECT string_agg(CASE WHEN r = '' THEN '' ELSE "
    "(CASE WHEN regexp_matches(r, '^[0-9]') THEN '\\d' WHEN regexp_matches(r, '^[A-Za-zÀ-ÿ]') THEN '\\w' "
    "WHEN r[1] IN ('-', '.', ' ') THEN '\\' || r[1] ELSE r[1] END) || "
    "(CASE WHEN length(r) > 1 THEN '{' || length(r) || '}' ELSE '' END) END, '' ORDER BY i) "
    "FROM (SELECT unnest(rs) AS r, generate_subscripts(rs, 1) AS i))"
)
_SQL_PATTERNS = (
    SQL_FREQ + ", runs AS (SELECT colonne, valeur, n, regexp_extract_all(valeur, '[0-9]+|[A-Za-zÀ-ÿ]+| +|\\.+|,+|-+|/+|[^0-9A-Za-zÀ-ÿ .,/-]+') AS rs FROM filled), "
    f"shaped AS (SELECT colonne, valeur, n, {_SQL_RUNS} AS whole FROM runs), "
    "motifs AS (SELECT colonne, valeur, n, whole, CASE WHEN length(whole) <= 48 THEN whole ELSE left(whole, 48) || '…' END AS motif FROM shaped), "
    "counted AS (SELECT colonne, whole, motif, CAST(sum(n) AS BIGINT) AS n, min(valeur) AS exemple FROM motifs GROUP BY ALL)"
)


@register("generalize_pattern", _SQL_PATTERNS + " SELECT colonne, valeur, motif FROM motifs")
def _(spark, folder):
    freq = value_frequencies(messy(spark, folder), MESSY_COLUMNS)
    return freq.where(F.col("valeur").isNotNull()).select(
        "colonne", "valeur", L.generalize_pattern(F.col("valeur")).alias("motif")
    )


_SQL_DOMINANT = (
    "dominant AS (SELECT colonne, arg_min(motif, (-n, whole)) AS motif_dominant, "
    "100.0 * max(n) / sum(n) AS couv, count(*) AS n_motifs FROM counted GROUP BY colonne)"
)


@register(
    "dominant_pattern",
    _SQL_PATTERNS + f", {_SQL_DOMINANT} SELECT colonne, motif_dominant, {R('couv')} AS \"couverture_motif_%\", n_motifs "
    "FROM dominant WHERE colonne IN ('ident', 'distance', 'jour', 'entier')",
)
def _(spark, folder):
    return profiling.dominant_pattern(messy(spark, folder), MESSY_COLUMNS)


@register(
    "pattern_breakdown",
    _SQL_PATTERNS + f" SELECT c.colonne, motif, n, {R('100.0 * n / sum(n) OVER (PARTITION BY c.colonne)')} AS \"part_%\", "
    "count(*) OVER (PARTITION BY c.colonne) AS n_motifs, exemple FROM counted c",
)
def _(spark, folder):
    return profiling.pattern_breakdown(messy(spark, folder), MESSY_COLUMNS)


_SQL_EXAMPLES = (
    "examples AS (SELECT colonne, string_agg(valeur, ' | ' ORDER BY rn) AS exemples FROM "
    "(SELECT *, row_number() OVER (PARTITION BY colonne ORDER BY n DESC, valeur) AS rn FROM filled) WHERE rn <= 3 GROUP BY colonne)"
)
_SQL_PROFILE = (
    _SQL_FACTS
    + _SQL_PATTERNS[len(SQL_FREQ) :]
    + f", {_SQL_DOMINANT}, {_SQL_EXAMPLES}, profile AS (SELECT r.colonne, '' AS type_reel, type_semantique, "
    "CASE WHEN type_semantique IN ('entier','decimal','date','identifiant') THEN motif_dominant END AS motif_dominant, "
    "CASE WHEN type_semantique IN ('entier','decimal','date','identifiant') THEN round(couv, 6) + 0.0 END AS \"couverture_motif_%\", "
    "CASE WHEN type_semantique IN ('entier','decimal','date','identifiant') THEN n_motifs END AS n_motifs, "
    f"n_distinct, n_distinct_normalise, \"min\", \"max\", {R('100.0 * (1 - remplies / lignes)')} AS \"null_%\", "
    f"{R('100.0 * (1 - taux_conforme)')} AS \"non_conforme_%\", coalesce(exemples, '') AS exemples, {_SQL_REMARKS.replace('colonne WHEN', 'r.colonne WHEN')} AS remarques "
    "FROM rated r LEFT JOIN dominant USING (colonne) LEFT JOIN examples USING (colonne))"
)


@register("profile_columns", _SQL_PROFILE + " SELECT * FROM profile")
def _(spark, folder):
    return profiling.profile_columns(messy(spark, folder), MESSY_COLUMNS)


@register(
    "profile_flags",
    _SQL_PROFILE + ' SELECT colonne, n_distinct = 1 AS constante, "non_conforme_%" > 0 AS nonconforme, "null_%" > 0 AS manquants FROM profile',
)
def _(spark, folder):
    return profiling.profile_flags(profiling.profile_columns(messy(spark, folder), MESSY_COLUMNS))


@register(
    "modality_breakdown",
    SQL_FREQ + ", m AS (SELECT colonne, cle, CAST(sum(n) AS BIGINT) AS n FROM keyed GROUP BY colonne, cle), "
    f"s AS (SELECT colonne, cle, n, {R('100.0 * n / sum(n) OVER (PARTITION BY colonne)')} AS part, count(*) OVER (PARTITION BY colonne) AS k FROM m) "
    "SELECT colonne, cle AS modalite, s.n, part AS \"part_%\", k AS n_modalites, valeur AS ecriture, keyed.n AS n_ecriture "
    "FROM keyed JOIN s USING (colonne, cle)",
)
def _(spark, folder):
    return profiling.modality_breakdown(messy(spark, folder), MESSY_COLUMNS)


@register(
    "modality_reduction",
    SQL_FREQ + " SELECT colonne, count(*) AS n_brut, count(DISTINCT cle) AS n_normalise, count(DISTINCT CASE WHEN colonne = 'filiere' THEN "
    + _SQL_RECODE_FILIERE.format(k="cle") + " ELSE " + _SQL_RECODE_BOURSIER.format(k="cle")
    + " END) AS n_recode FROM keyed WHERE colonne IN ('filiere', 'boursier') GROUP BY colonne",
)
def _(spark, folder):
    return profiling.modality_reduction(messy(spark, folder), VOCABULARY, ["filiere", "boursier"])


# --- preparation ------------------------------------------------------------------------------

_TYPES = {
    "distance": "decimal", "jour": "date", "filiere": "categoriel", "boursier": "booleen",
    "entier": "entier",
}
_SQL_CONFORMED = (
    f"{SQL_MESSY}, conformed AS (SELECT {_SQL_NUMBER.format(c='distance')} AS distance, "
    f"strftime({_SQL_DATE.format(c='jour')}, '%Y-%m-%d') AS jour, {sql_key('filiere')} AS filiere, "
    f"{sql_key('boursier')} AS boursier, CAST(entier AS BIGINT) AS entier FROM messy)"
)


@register("conform", f"WITH {_SQL_CONFORMED} SELECT * FROM conformed")
def _(spark, folder):
    typed = prepare.conform(messy(spark, folder).select(*_TYPES), _TYPES)
    return typed.withColumn("jour", F.date_format("jour", "yyyy-MM-dd"))


@register(
    "build_gold",
    f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, {R('CASE WHEN l_linenumber > 0 THEN l_quantity / l_linenumber END')} AS taux, "
    f"{R('CASE WHEN l_linenumber > 0 THEN l_tax / l_linenumber END')} AS ratio FROM lineitem",
)
def _(spark, folder):
    return prepare.build_gold(
        table(spark, folder, "lineitem"),
        ["l_returnflag", "l_linestatus", "l_shipdate"],
        {"taux": ("l_quantity", "l_linenumber"), "ratio": ("l_tax", "l_linenumber")},
    )


@register("dedup_exact", "SELECT DISTINCT * EXCLUDE (doc_id) FROM documents")
def _(spark, folder):
    return prepare.dedup_exact(table(spark, folder, "documents").drop("doc_id"))


_SQL_CLEAN = (
    f"WITH {_SQL_CONFORMED}, clean AS (SELECT distance, jour, {_SQL_RECODE_FILIERE.format(k='filiere')} AS filiere, "
    f"{_SQL_RECODE_BOURSIER.format(k='boursier')} AS boursier, entier FROM conformed)"
)


@register("transform", _SQL_CLEAN + " SELECT DISTINCT * FROM clean")
def _(spark, folder):
    clean = prepare.transform(messy(spark, folder).select(*_TYPES), _TYPES, VOCABULARY)
    return clean.withColumn("jour", F.date_format("jour", "yyyy-MM-dd"))


@register(
    "transform_facts",
    _SQL_CLEAN + " SELECT count(*) AS n_lignes_source, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM clean)) AS n_doublons_retires, "
    "5 AS n_colonnes, 'filiere, boursier' AS colonnes_recodees FROM clean",
)
def _(spark, folder):
    return prepare.transform_facts(messy(spark, folder).select(*_TYPES), _TYPES, VOCABULARY)


# --- joins and integrity ----------------------------------------------------------------------


@register(
    "orphan_keys",
    "SELECT DISTINCT concat('d#', CAST(doc_id AS VARCHAR)) AS cle FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
)
def _(spark, folder):
    fact = table(spark, folder, "documents").select(
        F.concat(F.lit("D#"), F.col("doc_id").cast("string")).alias("document")
    )
    known = table(spark, folder, "labels").select(
        F.concat(F.lit(" d#"), F.col("doc_id").cast("string")).alias("document")
    )
    return integrity.orphan_keys(fact, known, "document")


@register(
    "duplicate_keys",
    f"WITH {SQL_HOLES} SELECT 'l_orderkey' AS cle, count(*) - count(DISTINCT l_orderkey) AS n_doublons FROM holes UNION ALL "
    "SELECT 'g', count(*) - count(DISTINCT g) - max(CASE WHEN g IS NULL THEN 1 ELSE 0 END) FROM holes",
)
def _(spark, folder):
    return integrity.duplicate_keys(holes(spark, folder), ["l_orderkey", "g"])


@register(
    "order_violations",
    f"WITH {SQL_HOLES} SELECT 'q <= l_orderkey' AS regle, count(*) FILTER (q > l_orderkey) AS n_violations FROM holes UNION ALL "
    "SELECT 'd <= t', count(*) FILTER (d > t) FROM holes",
)
def _(spark, folder):
    return integrity.order_violations(holes(spark, folder), [("q", "l_orderkey"), ("d", "t")])


@register(
    "functional_dependency",
    "WITH k AS (SELECT n_regionkey, count(DISTINCT n_name) AS a, count(DISTINCT r_name) AS b FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) "
    "SELECT 'n_name' AS attribut, count(*) AS n_cles, count(*) FILTER (a > 1) AS n_cles_multiples, max(a) <= 1 AS dependance FROM k UNION ALL "
    "SELECT 'r_name', count(*), count(*) FILTER (b > 1), max(b) <= 1 FROM k",
)
def _(spark, folder):
    region = table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    joined = integrity.enrich(table(spark, folder, "nation"), region, "n_regionkey")
    return integrity.functional_dependency(joined, "n_regionkey", ["n_name", "r_name"])


@register(
    "align_modalities",
    "WITH a AS (SELECT o_orderstatus AS modalite, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT l_linestatus AS modalite, count(*) AS n FROM lineitem GROUP BY 1) "
    "SELECT modalite, coalesce(a.n, 0) AS n_reference, coalesce(b.n, 0) AS n_courant FROM a FULL JOIN b USING (modalite)",
)
def _(spark, folder):
    return integrity.align_modalities(
        table(spark, folder, "orders").select(F.col("o_orderstatus").alias("statut")),
        table(spark, folder, "lineitem").select(F.col("l_linestatus").alias("statut")),
        "statut",
    )


@register(
    "joint_overlap",
    f"WITH {SQL_HOLES}, r AS (SELECT DISTINCT q, f, s FROM holes WHERE l_orderkey % 2 = 1) SELECT "
    "count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE r.q IS NOT DISTINCT FROM h.q AND r.f IS NOT DISTINCT FROM h.f AND r.s IS NOT DISTINCT FROM h.s)) AS n_communes, "
    "count(*) AS n_lignes FROM holes h WHERE l_orderkey % 2 = 0",
)
def _(spark, folder):
    rows = holes(spark, folder)
    columns = ["q", "f", "s"]
    return integrity.joint_overlap(
        rows.where("l_orderkey % 2 = 0").select(*columns),
        rows.where("l_orderkey % 2 = 1").select(*columns),
    )
