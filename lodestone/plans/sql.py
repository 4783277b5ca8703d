"""Pieces of DuckDB SQL that the oracles share; they count by joins where the engine scans."""

from lodestone.config import STOP_WORDS
from lodestone.functions.text import PUNCTUATION, WS

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def quoted(s) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens(name: str, table: str, id: str, col: str) -> str:
    """CTE name(id, pos, term) of all tokens, stop words included."""
    return f"""{name}_l AS (SELECT {id} AS id, list_filter(regexp_split_to_array(regexp_replace(lower({col}), '{PUNCTUATION}', ' ', 'g'), '{WS}+'), lambda x: x <> '') AS l FROM {table}),
{name} AS (SELECT id, unnest(range(len(l)))::INT AS pos, unnest(l) AS term FROM {name}_l)"""


def live(name: str, table: str, id: str, col: str, stops: bool = True) -> str:
    """CTE name of the tokens that aren't stop words, or of all."""
    return f"{tokens(name + '_all', table, id, col)},\n{name} AS (SELECT * FROM {name}_all WHERE {f'term NOT IN ({STOPS})' if stops else 'TRUE'})"


BM25 = "ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * c.tf * ({k1} + 1) / (c.tf + {k1} * (1 - {b} + {b} * l.n / s.a))"
TFIDF = "(1 + ln(c.tf)) * (ln((s.n + 1) / (d.df + 1)) + 1)"


def scores(table: str, id: str, fields: dict, terms: list, ranking: str = "bm25", k1: float = 1.2, b: float = 0.75, stops: bool = True) -> str:
    """CTEs up to base(id, score) and shares(id, query, term, field, tf, share); terms are (query, term, factor)."""
    formula = TFIDF if ranking == "tfidf" else BM25.format(k1=k1, b=b)
    parts = [f"q(query, term, factor) AS (VALUES {', '.join(f'({quoted(a)}, {quoted(t)}, {f}::DOUBLE)' for a, t, f in terms)})"]
    for f, w in fields.items():
        parts.append(
            f"""{live("t_" + f, table, id, f, stops)},
l_{f} AS (SELECT d.{id} AS id, count(t.term)::DOUBLE AS n FROM {table} d LEFT JOIN t_{f} t ON t.id = d.{id} GROUP BY 1),
s_{f} AS (SELECT count(*)::DOUBLE AS n, CASE WHEN avg(n) > 0 THEN avg(n) ELSE 1 END AS a FROM l_{f}),
c_{f} AS (SELECT id, term, count(*)::DOUBLE AS tf FROM t_{f} SEMI JOIN q USING (term) GROUP BY 1, 2),
d_{f} AS (SELECT term, count(*)::DOUBLE AS df FROM c_{f} GROUP BY 1),
x_{f} AS (SELECT c.id, q.query, c.term, '{f}' AS field, c.tf::INT AS tf, {w} * q.factor * {formula} AS share FROM c_{f} c JOIN d_{f} d USING (term) JOIN q USING (term) JOIN l_{f} l USING (id), s_{f} s)"""
        )
    parts.append("shares AS (" + " UNION ALL ".join(f"SELECT * FROM x_{f}" for f in fields) + ")")
    parts.append("base AS (SELECT id, sum(share) AS score FROM shares GROUP BY id)")
    return ",\n".join(parts)


def top(select: str, limit: int = 10, offset: int = 0, order: str = "score DESC, 1") -> str:
    return f"{select} ORDER BY {order} LIMIT {limit} OFFSET {offset}"
