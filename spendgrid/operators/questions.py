"""Finance questions as a table: fold, parse, detect entities, route and answer in one
batch (F5, F10, F11, F12).

Values stay columns (no SQL strings are built from user text). Entity names meet the
questions in equi-joins on character n-grams, whatever the size of a catalog.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendgrid.functions.matching import containing
from spendgrid.functions.measures import any_of
from spendgrid.session import stored

# ---------------------------------------------------------------------------------------
# accent folding. The translate table is derived by rule: every code point of the
# Latin-1 Supplement and Latin Extended-A/B blocks whose NFKD form is one base letter
# followed by combining marks maps to that base letter.


def _fold_table() -> tuple[str, str]:
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if base != ch and len(base) == 1:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


FOLD_SRC, FOLD_DST = _fold_table()


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fold_text(c: Column, exact: bool = False) -> Column:
    """accent-fold + lower + trim. ``exact=True`` uses an Arrow pandas UDF with full
    NFKD (covers every script); the default is a JVM-side ``translate``."""
    if exact:
        return strip_ws(F.lower(_nfkd_fold(c)))
    return strip_ws(F.lower(F.translate(c, FOLD_SRC, FOLD_DST)))


@F.pandas_udf(T.StringType())
def _nfkd_fold(s):  # pragma: no cover - exercised through fold_text(exact=True)
    def one(x):
        if x is None:
            return None
        return "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch))

    return s.map(one)


# ---------------------------------------------------------------------------------------
# Phrase patterns and keyword lists of the question parser.
WEEK_PHRASES = (
    r"acumulado\s+a\s+la\s+semana|acumulado\s+a\s+semana|hasta\s+la\s+semana|hasta\s+semana|semana|sem"
)
WEEKLY_KEYWORDS = ["desglosado por semana", "por semana", "semanal", "evolucion semanal", "semana a semana", "historico semanal"]
CENTRE_PHRASES = r"ceco|centro de costos?|centro|cecos?"
MATCH_KEYWORDS = ["match", "mapeo", "cruces"]
GENERIC_DIVISION_WORDS = ["division", "direccion", "de"]
GENERIC_TERRITORY_WORDS = ["territorio", "de"]
GROUP_SYNONYMS = [
    ("nomina", ["nomina", "sueldo", "salario", "personal", "servicios personales"]),
    ("mantenimiento", ["mantenimiento", "mtto", "edificio", "maquinaria", "local"]),
    ("publicidad", ["publicidad", "mercadotecnia", "difusion"]),
    ("renta", ["renta", "luz", "telefono", "alquiler"]),
    ("flete", ["flete", "traslado", "transporte"]),
    ("operacion", ["operacion", "operativo", "gastos de operacion"]),
    ("honorarios", ["honorario", "asesoria", "consultoria"]),
]

# word boundaries are spelled as ASCII classes so the same pattern means the same thing
# in every regex engine
_L, _R = r"(?:^|[^a-z0-9_])", r"(?:[^a-z0-9_]|$)"
WEEK_RE = _L + "(" + WEEK_PHRASES + r")\s*#?\s*([0-9]{1,2})" + _R
CENTRE_RE = _L + "(" + CENTRE_PHRASES + r")\s*#?\s*([0-9]{3,8})" + _R
LOOSE_ID_RE = _L + r"([0-9]{4,6})" + _R


def parse_questions(df: DataFrame, text: str = "question", smr: int = 30, loose_ids: bool = False) -> DataFrame:
    """``folded``, ``cut`` week (1..53 from a week phrase, else SMR),
    ``cumulative`` flag, ``weekly`` breakdown flag and ``centre_id`` (phrase; with
    ``loose_ids`` also the first bare 4-6 digit number)."""
    folded = fold_text(F.col(text))
    out = df.withColumn("folded", folded)
    wk = F.regexp_extract("folded", WEEK_RE, 2)
    wk_i = F.when(wk != "", wk.cast("int"))
    valid = wk_i.isNotNull() & (wk_i >= 1) & (wk_i <= 53)
    centre = F.regexp_extract("folded", CENTRE_RE, 2)
    centre_id = F.when(centre != "", centre)
    if loose_ids:
        loose = F.regexp_extract("folded", LOOSE_ID_RE, 1)
        centre_id = F.coalesce(centre_id, F.when(loose != "", loose))
    return out.withColumns(
        {
            "cut": F.when(valid, wk_i).otherwise(F.lit(smr)),
            "cumulative": valid,
            "weekly": any_of([F.col("folded").contains(k) for k in WEEKLY_KEYWORDS]),
            "centre_id": centre_id,
        }
    )


def catalog_tokens(catalog: DataFrame, name: str, generic: list[str]) -> DataFrame:
    """Folded catalog names split into tokens longer than 3 letters, generic words out."""
    c = catalog.select(F.col(name).alias("name")).filter(F.col("name").isNotNull()).distinct()
    t = c.select("name", F.explode(F.split(fold_text(F.col("name")), r"\s+")).alias("tok"))
    return t.filter((F.length("tok") > 3) & ~F.col("tok").isin(generic))


def detect_entities(q: DataFrame, divisions: DataFrame, territories: DataFrame, groups: DataFrame) -> DataFrame:
    """division and territory by any catalog token (> 3 letters, generic words
    skipped) found in the folded question, first by name; group by its full folded name,
    else through the synonym lists (first key in list order, then the first group whose
    folded name holds the key or a synonym)."""
    spark = q.sparkSession
    g = groups.select(F.col("grupo").alias("name")).filter(F.col("name").isNotNull()).distinct()
    g = g.withColumn("tok", fold_text(F.col("name")))
    syn = spark.createDataFrame([(i, k, s) for i, (k, ss) in enumerate(GROUP_SYNONYMS) for s in ss], "key_ord int, name string, tok string")
    kinds = {
        "division": catalog_tokens(divisions, "division", GENERIC_DIVISION_WORDS),
        "territory": catalog_tokens(territories, "territorio", GENERIC_TERRITORY_WORDS),
        "g_name": g,
        "key": syn,
    }
    tokens = None
    for kind, t in kinds.items():  # all catalogs at once: each question is read once
        t = t.select(F.lit(kind).alias("kind"), "name", "tok", F.col("key_ord") if kind == "key" else F.lit(None).cast("int").alias("key_ord"))
        tokens = t if tokens is None else tokens.unionByName(t)
    hits = stored(containing(q.select("id", "folded"), "id", "folded", tokens, "tok").drop("tok"), "question-entities")
    first = hits.groupBy("id").agg(*[F.min(F.when(F.col("kind") == k, F.col("name"))).alias(k) for k in ("division", "territory", "g_name")])
    # every synonym key a question mentions
    key_hit = hits.filter("kind = 'key'").select("id", F.col("name").alias("key"), "key_ord").distinct()
    # the first group a key resolves to: its folded name holds the key or any of its synonyms
    words = syn.select(F.col("name").alias("key"), F.col("tok").alias("word"))
    words = words.unionByName(syn.select(F.col("name").alias("key"), F.col("name").alias("word"))).distinct()
    key_group = containing(g, "name", "tok", words, "word").groupBy("key").agg(F.min("name").alias("s_name"))
    # first key (in list order) that both appears and resolves
    by_syn = key_hit.join(key_group, "key").groupBy("id").agg(F.min_by("s_name", "key_ord").alias("s_name"))
    return (
        q.join(first, "id", "left")
        .join(by_syn, "id", "left")
        .withColumn("grupo", F.coalesce("g_name", "s_name"))
        .drop("g_name", "s_name")
    )


ROUTES = ["weekly", "centre", "match", "division", "territory", "group", "general"]


def route_column() -> Column:
    """F12 route order: weekly > centre > match > division > territory > group > general."""
    return (
        F.when(F.col("weekly"), "weekly")
        .when(F.col("centre_id").isNotNull(), "centre")
        .when(any_of([F.col("folded").contains(k) for k in MATCH_KEYWORDS]), "match")
        .when(F.col("division").isNotNull(), "division")
        .when(F.col("territory").isNotNull(), "territory")
        .when(F.col("grupo").isNotNull(), "group")
        .otherwise("general")
    )


def answer_questions(q: DataFrame, long: DataFrame, wide: dict[str, str] | None = None) -> DataFrame:
    """route every question and attach its R25/P26/R26 totals up to its cut week.

    Scope per route: weekly -> centre?, division?, group?; centre -> centre, group?;
    division -> division, group?; territory -> territory, group?; group -> group;
    match/general -> everything. A centre id names one centre (exact id).

    ``long`` is the long fact (serie, monto). With ``wide={'R25': col, ...}`` the same
    sums come straight from a wide fact's measure columns, skipping the 4x unpivot.

    The facts are read once, summed by the four scope dimensions and week. For each kind of
    scope that some question names (at most ten), only the facts of the named scopes are summed
    on, up to each cut; a question then takes its scope's answer. Questions with the same scope
    and cut share one answer, so a scope that most of them name is joined as one row.
    """
    r = q.withColumn("route", route_column())
    rt = F.col("route")
    scope = {
        "division_f": F.when(rt.isin("weekly", "division"), F.col("division")),
        "territorio_f": F.when(rt == "territory", F.col("territory")),
        "grupo_f": F.when(rt.isin("weekly", "centre", "division", "territory", "group"), F.col("grupo")),
        "centre_f": F.when(rt.isin("weekly", "centre"), F.col("centre_id").try_cast("bigint")),
    }
    r = r.withColumns(scope)
    scopes = {"division_f": "division", "territorio_f": "territorio", "grupo_f": "grupo", "centre_f": "centre"}
    named = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(d)) for f, d in scopes.items()]))
    r = stored(r.select("id", "route", "cut", *scopes).withColumn("named", named), "question-scopes")
    codes = ("R25", "P26", "R26")
    zero = F.lit(0).cast("decimal(18,5)")
    if wide:
        sums = [F.sum(F.col(wide[c])).alias(c) for c in codes]
    else:
        sums = [F.sum(F.when(F.col("serie") == c, F.col("monto")).otherwise(zero)).alias(c) for c in codes]
    base = stored(long.groupBy(*scopes.values(), "sem").agg(*sums), "question-facts")
    asked = r.select("named", "cut", *scopes).distinct()
    answers = None
    for (kind,) in sorted(r.select("named").distinct().collect()):  # at most ten kinds of scope
        dims = [(f, d) for f, d in scopes.items() if d in kind]
        want = asked.filter(F.col("named") == F.array(*[F.lit(d) for d in kind]).cast("array<string>"))
        f = base
        if dims:
            keys = want.select(*[F.col(a).alias(d) for a, d in dims]).distinct()
            f = f.join(keys, [d for _, d in dims], "left_semi")
        f = f.groupBy(*[d for _, d in dims], "sem").agg(*[F.sum(c).alias(c) for c in codes])  # a scope's weeks
        on = F.col("sem") <= F.col("cut")
        for a, d in dims:
            on = on & (F.col(a) == F.col(d))
        part = want.join(f, on, "left").groupBy("named", "cut", *scopes).agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in codes])
        answers = part if answers is None else answers.unionByName(part)
    if answers is None:
        answers = asked.select("*", *[zero.alias(c) for c in codes]).limit(0)
    same = F.lit(True)
    for c in ("cut", *scopes):
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}"))
    out = r.alias("r").join(answers.alias("a"), same).select("r.id", "r.route", "r.cut", *[f"r.{f}" for f in scopes], *codes)
    return out.select(
        "id",
        "route",
        "cut",
        F.col("division_f").alias("division"),
        F.col("territorio_f").alias("territorio"),
        F.col("grupo_f").alias("grupo"),
        F.col("centre_f").alias("centre"),
        *[F.round(c, 2).cast("double").alias(c) for c in ("R25", "P26", "R26")],
        F.round(F.col("R26") - F.col("P26"), 2).cast("double").alias("vs_plan"),
    )
