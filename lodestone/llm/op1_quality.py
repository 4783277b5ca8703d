"""Quality rules, line first: rules judge each line, failing lines go, and a document that loses too much is rejected.

Native: only DataFrame functions, one pass, no shuffle. Repeated 3-word windows are found by sorting
64-bit longs that hold a window's hash above its position; neighbours with equal hashes are compared
word by word, so a hash never decides alone.

Defined results: null, empty or blank text has no words, base_failed and not kept; a text without line
breaks is one line; blank lines are neither kept nor lost; repeated rows are judged alike; extra
columns are ignored (quality_rules keeps them and drops those that clash with its own).
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACES, read_table, words

NAME = "op1_quality_rules"

SYMBOLS = "[^#*$%&|<>]+"

#: Phrases of notices and calls in English, German, French and Spanish, tried one language after the other.
#: Accented letters stand in both cases and not beside a \b: engines differ in how they fold them and whether they are of words.
BOILERPLATE = (
    r"(?i)\b(all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings|consent)|"
    r"accept (all )?cookies|click here|read more|sign (in|up)|log ?in|subscribe|newsletter|lorem ipsum|"
    r"(enable|requires) javascript|share (this|on)|follow us|copyright|licen[sc]ed under|skip to content|"
    r"alle rechte vorbehalten|datenschutzerkl[äÄ]rung|nutzungsbedingungen|cookie-(einstellungen|richtlinie)|cookies (akzeptieren|zulassen)|"
    r"hier klicken|jetzt (anmelden|registrieren|abonnieren)|folgen sie uns|zum inhalt springen|"
    r"mentions l[éÉ]gales|conditions (d'utilisation|g[éÉ]n[éÉ]rales)|(accepter|g[éÉ]rer) les cookies|"
    r"cliquez ici|inscrivez-vous|abonnez-vous|connectez-vous|suivez-nous|aller au contenu|"
    r"todos los derechos reservados|pol[íÍ]tica de (privacidad|cookies)|t[éÉ]rminos (de uso|y condiciones)|aviso legal|(aceptar|configurar) (las |todas las )?cookies|"
    r"iniciar sesi[óÓ]n|suscr[íÍ]bete|s[íÍ]guenos|saltar al contenido)\b|\b(tous droits r[éÉ]serv|politique de confidentialit|haga clic aqu)|©|\(c\) ?\d{4}"
)
#: A line of nothing but a way to elsewhere, in the same languages, or one that begins with a menu's mark.
NAVIGATION = (
    r"(?i)^[\x20\x09-\x0D]*([|»›•·>/]|(home|menu|next|previous|back to top|startseite|weiter|zur[üÜ]ck|nach oben|mehr (lesen|erfahren)|weiterlesen|"
    r"accueil|suivant|pr[éÉ]c[éÉ]dent|haut de page|lire la suite|en savoir plus|inicio|siguiente|anterior|volver arriba|leer m[áÁ]s)[\x20\x09-\x0D.!:]*$)"
)
SEPARATORS = r"[|»›•·][^|»›•·]*[|»›•·]"
TERMINAL = r"^[.!?…。！？:;\"'”’»)\]]$"
ALL_MARKS = r"^[\p{P}\p{S}\s]+$"


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the document's verdict."""

    #: A line without a closing mark fails if it has fewer words than this.
    min_open_words: int = 8
    #: A line with one of the boilerplate phrases fails if it has no more words than this.
    max_boilerplate_words: int = 40
    #: A line fails if it has more of the characters #*$%&|<> than this, for each word.
    max_symbols_per_word: float = 0.5
    #: A document is rejected if more than this share of its word characters goes with its failing lines.
    max_lost_share: float = 0.5


def _line_fails(line: Column, n: Column, rules: LineRules) -> Column:
    """Patterns are anchored or tried on short lines only, so that a very long line costs no more than its length."""
    return (
        ((n < rules.min_open_words) & ~F.right(F.trim(line, F.lit(SPACES)), F.lit(1)).rlike(TERMINAL))
        | (F.length(F.regexp_replace(line, SYMBOLS, "")) > rules.max_symbols_per_word * n)
        | line.rlike(ALL_MARKS)
        | line.rlike(SEPARATORS)
        | ((n <= rules.max_boilerplate_words) & line.rlike(NAVIGATION))
        | ((n <= rules.max_boilerplate_words) & line.rlike(BOILERPLATE))
    )


def _word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))


def quality_rules(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, clean_text, base_failed, kept."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "clean_text", "base_failed", "kept"]
    inner = ["__t", "__w", "__l", "__s", "__d", "__bits", "__ok"]
    keep = [c for c in docs.columns if c not in made + inner]
    df = docs.select(*keep, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    df = df.withColumns({"__w": words(F.col("__t")), "__l": F.filter(F.split("__t", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")})
    df = df.withColumn("n_words", F.size("__w").cast("long"))
    df = df.withColumn("__bits", F.length(F.bin("n_words")))
    # a window's hash above its position, so that equal windows stand side by side once sorted
    windows = F.when(
        F.col("n_words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.col("n_words").cast("int") - 3),
            lambda i: F.call_function("shiftleft", F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)), F.col("__bits")).bitwiseOR(i.cast("long")),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__s", F.sort_array(windows))
    counted = F.transform("__l", lambda x: F.struct(x.alias("x"), F.size(words(x)).alias("n")))
    df = df.withColumn("__ok", F.transform(F.filter(counted, lambda x: ~_line_fails(x["x"], x["n"], rules)), lambda x: x["x"]))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bits")) - 1).cast("int")

    def same(x: Column, y: Column) -> Column:
        p, q = place(x), place(y)
        equal = F.call_function("shiftright", x, F.col("__bits")) == F.call_function("shiftright", y, F.col("__bits"))
        for k in range(3):
            equal = equal & (F.get("__w", p + k) == F.get("__w", q + k))
        return equal

    pairs = F.transform("__s", lambda x, i: F.when(same(x, F.get("__s", i + 1)), F.array(place(x), place(F.get("__s", i + 1)))))
    df = df.withColumn("__d", F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs)))))
    state = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("__d", state, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])
    df = df.select(
        *keep,
        "n_words",
        _word_chars(F.col("__t")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.array_join("__ok", "\n").alias("clean_text"),
    )
    df = df.withColumn("lost_chars", F.col("word_chars") - _word_chars(F.col("clean_text")).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= rules.max_lost_share * F.col("word_chars")))


def query(spark, sf_dir):
    out = quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def _sql(rules: LineRules = LineRules()) -> str:
    q = lambda x: x.replace("'", "''")
    blank = r"[ \t\n\x0B\f\r]"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{blank}+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g WHERE i + 2 <= len(w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
n AS (SELECT doc_id, line, len(list_filter(regexp_split_to_array(line, '{blank}+'), lambda x: x <> '')) AS nw, length(regexp_replace(line, '{blank}', '', 'g')) AS nc FROM l),
f AS (SELECT doc_id, line, nc, (NOT regexp_matches(right(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1), '{q(TERMINAL)}') AND nw < {rules.min_open_words})
  OR length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > {rules.max_symbols_per_word} * nw OR regexp_matches(line, '{q(ALL_MARKS)}') OR regexp_matches(line, '{q(SEPARATORS)}')
  OR (nw <= {rules.max_boilerplate_words} AND regexp_matches(line, '{q(NAVIGATION)}'))
  OR (nw <= {rules.max_boilerplate_words} AND regexp_matches(line, '{q(BOILERPLATE)}')) AS fails FROM n WHERE nw > 0),
d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(nc) FILTER (WHERE fails), 0) AS lost FROM f GROUP BY doc_id),
a AS (SELECT t.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(text, '{blank}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(d.n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(d.lost, 0)::BIGINT AS lost_chars
  FROM t JOIN w USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= {rules.max_lost_share} * word_chars AS kept FROM a
"""


ORACLE_SQL = _sql()
