import re
from collections import Counter

from lodestone.llm.op1_quality import LineRules, quality_rules

PROSE = "One plain sentence of nine words stands right here. "


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def texts():
    varied = "\n".join(f"Line {i} tells of thing{i} and of matter{i} with words{i} enough." for i in range(12))
    return {
        "varied": varied, "null": None, "empty": "", "blank": " \n\t", "one": "word", "repeats": PROSE * 30, "overlap": "a a a a a", "lines": "x y.\nx y.\n\n \nx y.", "symbols": varied.replace(" ", "### "),
        "menu": varied + "\nHome | About | News | Contact\n© 2024 all rights reserved.", "junk": "\n".join(["Home | About | News"] * 40), "wide": "ä" * 70_000 + " b", "unicode": " a b c", "long": varied * 50,
    }


def test_base_counts_like_brute_force(spark):
    t = texts()
    rows = spark.createDataFrame([(k, v, "clash") for k, v in t.items()] + [("varied", t["varied"], "again")], "doc_id string, text string, kept string")
    got = quality_rules(rows).collect()
    assert len(got) == len(t) + 1
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t[r.doc_id]), r.doc_id


def test_lines_decide(spark):
    t = texts()
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(list(t.items()), "doc_id string, text string")).collect()}
    assert got["varied"].kept and got["varied"].lost_chars == 0 and got["varied"].clean_text == t["varied"]
    assert got["menu"].kept and got["menu"].clean_text == t["varied"]
    assert not any(got[k].kept for k in ("null", "empty", "blank", "one", "repeats", "symbols", "junk"))
    strict = quality_rules(spark.createDataFrame([("menu", t["menu"])], "doc_id string, text string"), LineRules(max_lost_share=0.0)).first()
    assert not strict.kept


def test_empty_table_and_native_plan(spark):
    out = quality_rules(spark.createDataFrame([], "doc_id bigint, text string, x int"))
    assert out.collect() == [] and out.columns[:3] == ["doc_id", "text", "x"]
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_boilerplate_of_four_languages(spark):
    prose = texts()["varied"]
    bad = ["Alle Rechte vorbehalten, auch an den Bildern dieser Seite und am Text.", "Tous droits réservés, y compris ceux des images de cette page et du texte.", "ABONNEZ-VOUS à notre lettre et ne manquez plus aucun de nos articles.",
           "Consulte la POLÍTICA de privacidad para saber cómo tratamos los datos de las visitas.", "Mit Cookies akzeptieren stimmen Sie der Speicherung auf Ihrem Gerät gern zu.", "Home.", "Zurück!", "En savoir plus:", "Leer más."]
    good = ["Wir wollen mehr erfahren und lesen weiter, bis wir alles davon verstehen.", "Pour en savoir plus, elle a lu tout le livre en une seule nuit.", "They went home.", "El anterior alcalde llegó."]
    rows = [(k, prose + "\n" + x) for k, x in enumerate(bad + good)]
    got = {r.doc_id: r.clean_text for r in quality_rules(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {k: prose if k < len(bad) else t for k, t in rows}
