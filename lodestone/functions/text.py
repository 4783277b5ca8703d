"""Text analysis as Column expressions.

White space is that of Unicode, and punctuation the classes P and S. Positions are counted before stop words
go, so gaps stay visible to phrases. Everything is native: Unicode normalization calls the library that Spark
itself has for collations, for the texts that aren't proved normal by their characters alone.
"""

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.config import TokenizerOptions

WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same characters for Spark: the few ranges before && turn most others away, before each of WS's own is tried.
SPACE = rf"[\x{{0}}-\x{{20}}\x{{A0}}\x{{1680}}-\x{{FEFF}}&&{WS}]"
PUNCTUATION = r"[\p{P}\p{S}]"
SPACES = frozenset(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
DEFAULT = TokenizerOptions()
#: Characters that NFC and NFKC leave alone next to any others of them: not all, but those of most texts in Latin, Greek, Cyrillic, Han and kana.
INERT = (
    r"\x{0}-\x{9F}\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{180}-\x{1C3}\x{1CD}-\x{1F0}\x{1F4}-\x{2AF}"
    r"\x{386}\x{388}-\x{38A}\x{38C}\x{38E}-\x{3A1}\x{3A3}-\x{3CF}\x{400}-\x{482}\x{48A}-\x{52F}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{2030}-\x{2032}\x{2039}-\x{203B}\x{20AC}"
    r"\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FE}\x{4E00}-\x{9FFF}"
)


#: Method of the JVM's normalizer and its second argument, by form.
_FORMS = {"NFC": ("compose", False), "NFKC": ("compose", True), "NFD": ("decompose", False), "NFKD": ("decompose", True)}


def normalize_unicode(text: Column, form: str = "NFKC") -> Column:
    """text in the form. Spark takes the call for one without a fixed result: it may stand in no aggregate function."""
    method, compatible = _FORMS[form]
    inert = INERT if form in ("NFC", "NFKC") else r"\x{0}-\x{7F}"
    # most characters pass the first class, which has few ranges: a long one tries all of its own on each
    passed = r"\x{0}-\x{9F}\x{BF}-\x{131}" if form in ("NFC", "NFKC") else inert
    made = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), F.coalesce(text, F.lit("")), F.lit(compatible))
    return F.when(text.rlike(f"[^{passed}](?<![{inert}])"), made).otherwise(text)


def lower(text: Column, locale: str | None = None) -> Column:
    """Lower case by the rules of a language."""
    if locale and locale.split("-")[0] in ("tr", "az"):
        text = F.replace(F.replace(text, F.lit("I"), F.lit("ı")), F.lit("İ"), F.lit("i"))
    elif locale and locale.split("-")[0] == "lt":
        for a, b in (("Ì", "i̇̀"), ("Í", "i̇́"), ("Ĩ", "i̇̃")):
            text = F.replace(text, F.lit(a), F.lit(b))
    return F.lower(text)


def handle_punctuation(text: Column, mode: str = "replace") -> Column:
    if mode == "preserve":
        return text
    return F.regexp_replace(text, PUNCTUATION, " " if mode == "replace" else "")


def is_punctuation(char: Column) -> Column:
    return char.rlike(rf"^{PUNCTUATION}$")


def spaced(text: Column) -> Column:
    """text with plain spaces for all white space: ASCII's by plain replacement, and a class is tried only on texts that hold other characters."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    wide = lambda t: (F.octet_length(t) > F.length(t)) & t.rlike(r"[\x{A0}\x{1680}-\x{FEFF}]")
    return bound(text, lambda t: F.when(wide(t), F.regexp_replace(t, SPACE, " ")).otherwise(t))


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def prepared(text: Column, options: TokenizerOptions = DEFAULT) -> Column:
    if options.normalization:
        text = normalize_unicode(text, options.normalization)
    if options.lowercase:
        text = lower(text, options.locale)
    return handle_punctuation(text, options.punctuation)


def normalize_token(text: Column, options: TokenizerOptions = DEFAULT) -> Column:
    """The key of a term lookup: the whole string normalized, never split."""
    return normalize_whitespace(prepared(text, options))


def split_tokens(text: Column) -> Column:
    return F.filter(F.split(spaced(text), " "), lambda x: x != "")


def raw_tokens(text: Column, options: TokenizerOptions = DEFAULT) -> Column:
    """All tokens in order, stop words included; null text has none."""
    return F.coalesce(split_tokens(prepared(text, options)), F.array().cast("array<string>"))


def remove_stop_words(tokens: Column, words=DEFAULT.stop_words) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(list(words))) if words else tokens


def detailed(text: Column, options: TokenizerOptions = DEFAULT) -> Column:
    """array<struct<token, position>> after stop words, stems and n-grams."""
    out = F.transform(raw_tokens(text, options), lambda x, i: F.struct(x.alias("token"), i.alias("position")))
    if options.stop_words:
        out = F.filter(out, lambda x: ~x["token"].isin(list(options.stop_words)))
    if options.stemmer:
        out = F.transform(out, lambda x: F.struct(options.stemmer(x["token"]).alias("token"), x["position"].alias("position")))
        out = F.filter(out, lambda x: x["token"] != "")
    if options.ngrams:
        out = ngram_structs(out, *options.ngrams, options.separator)
    return out


def tokenize(text: Column, options: TokenizerOptions = DEFAULT) -> Column:
    if options.stemmer or options.ngrams:
        return F.transform(detailed(text, options), lambda x: x["token"])
    return remove_stop_words(raw_tokens(text, options), options.stop_words)


def bound(value: Column, made) -> Column:
    """made(value), with value worked out once and outside of made's own lambdas, where no UDF may stand."""
    return F.get(F.transform(F.array(value), made), 0)


def starts(tokens: Column, n: int) -> Column:
    """Places at which n elements begin."""
    return F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))


def ngrams(tokens: Column, shortest: int, longest: int, separator: str = " ") -> Column:
    """All n-grams, shorter ones first."""
    TokenizerOptions(ngrams=(shortest, longest))
    one = lambda t, n: F.transform(starts(t, n), lambda i: F.array_join(F.slice(t, i + 1, n), separator))
    return bound(tokens, lambda t: reduce(F.concat, [one(t, n) for n in range(shortest, longest + 1)]))


def ngram_structs(tokens: Column, shortest: int, longest: int, separator: str = " ") -> Column:
    def one(t, n):
        def at(i):
            part = F.slice(t, i + 1, n)
            return F.struct(F.array_join(F.transform(part, lambda x: x["token"]), separator).alias("token"), F.get(part, 0)["position"].alias("position"))

        return F.transform(starts(t, n), at)

    return bound(tokens, lambda t: reduce(F.concat, [one(t, n) for n in range(shortest, longest + 1)]))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


class Analyzer:
    """The same analysis of single strings on the driver, for queries, and for offsets of highlighted text."""

    def __init__(self, options: TokenizerOptions = DEFAULT):
        self.options = options

    @staticmethod
    def _space(c: str) -> bool:
        return c in SPACES

    def _normal(self, text: str) -> str:
        return unicodedata.normalize(self.options.normalization, text) if self.options.normalization else text

    def _lower(self, text: str) -> str:
        language = (self.options.locale or "").split("-")[0]
        if language in ("tr", "az"):
            text = text.replace("I", "ı").replace("İ", "i")
        elif language == "lt":
            for a, b in (("Ì", "i̇̀"), ("Í", "i̇́"), ("Ĩ", "i̇̃")):
                text = text.replace(a, b)
        return text.lower()

    def _joined(self, before: str, c: str) -> bool:
        """Whether c is normalized together with what stands before it: marks, and what composes without being one."""
        return c >= "\u0300" and (unicodedata.combining(c) > 0 or self._normal(before + c) != self._normal(before) + self._normal(c))

    def spans(self, text: str) -> list[tuple[str, int, int, int]]:
        """(token, position, start, end) in characters of text, stop words left out."""
        o, out, word, start, end, position = self.options, [], [], 0, 0, 0

        def close():
            nonlocal position
            if word:
                token = "".join(word)
                if token not in o.stop_words:
                    out.append((token, position, start, end))
                position += 1
                word.clear()

        i = 0
        while i < len(text):
            j = i + 1
            while j < len(text) and self._joined(text[i:j], text[j]):
                j += 1
            for c in self._normal(text[i:j]):
                c = self._lower(c) if o.lowercase else c
                mark = unicodedata.category(c[0])[0] in "PS"
                if self._space(c) or mark and o.punctuation == "replace":
                    close()
                elif not (mark and o.punctuation == "remove"):
                    if not word:
                        start = i
                    word.append(c)
                    end = j
            i = j
        close()
        return out

    def tokens(self, text: str) -> list[str]:
        return [t for t, _, _, _ in self.spans(text)]

    def key(self, text: str) -> str:
        """normalize_token of one string."""
        o = self.options
        text = self._normal(text)
        text = self._lower(text) if o.lowercase else text
        if o.punctuation != "preserve":
            text = "".join((" " if o.punctuation == "replace" else "") if unicodedata.category(c)[0] in "PS" else c for c in text)
        return " ".join("".join(" " if self._space(c) else c for c in text).split())


def analyzed(spark, texts: list[str], options: TokenizerOptions = DEFAULT) -> list[list[tuple[str, int]]]:
    """(token, position) of each of a few strings, analysed as documents are: on the driver, or, for what only Columns can do, by a small job."""
    if not (options.stemmer or options.ngrams):
        return [[(t, p) for t, p, _, _ in Analyzer(options).spans(x)] for x in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, x string").select("k", detailed(F.col("x"), options).alias("t")).collect()
    return [[(t.token, t.position) for t in r.t] for r in sorted(rows, key=lambda r: r.k)]


def offsets(rows, column: str, options: TokenizerOptions = DEFAULT):
    """rows with tokens array<struct<token, position, start, end>>: the places of single tokens in the text as it was, in UTF-16 units, by Arrow batches."""
    if options.stemmer or options.ngrams:
        raise ValueError("offsets are those of single tokens without stems")
    import pandas as pd

    @F.pandas_udf("array<struct<token: string, position: int, start: int, end: int>>")
    def spans(s: pd.Series) -> pd.Series:
        an = Analyzer(options)
        return s.map(lambda x: [(t, p, utf16_offset(x, a), utf16_offset(x, b)) for t, p, a, b in an.spans(x)] if x is not None else [])

    return rows.withColumn("tokens", spans(F.col(column)))


def utf16_offset(text: str, at: int) -> int:
    return len(text[:at].encode("utf-16-le")) // 2
