from brute import DOCS, documents, empty, repeat_words, words
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm.quality import quality_rules


def test_base_figures(spark):
    rows = {r.doc_id: r for r in quality_rules(documents(spark)).collect()}
    for i, text, _ in DOCS:
        r, t = rows[i], text or ""
        assert (r.n_words, r.word_chars) == (len(words(t)), sum(map(len, words(t)))), i
        assert r.n_symbols == sum(t.count(c) for c in "#*$%&|<>")
        assert r.n_repeat_words == repeat_words(t)
        lines = [x for x in t.split("\n") if words(x)]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_lines_and_verdicts(spark):
    good = "A sentence of prose that ends as prose does, and that has enough words to pass the base rules of this test."
    menu, cookie, shout = "Home | News | About | Contact.", "We use cookies.", "BUY!! NOW!! CHEAP!!"
    rows = [(1, f"{good}\n{menu}\n{cookie}\n{shout}\nno end", "a"), (2, f"{good}\n" + "".join(f"A{i} | B{i} | C{i} | D{i} | E{i}.\n" for i in range(20)), "a"), (3, f"{good} »Quoted.«", "a")]
    out = {r.doc_id: r for r in quality_rules(documents(spark, rows)).collect()}
    assert out[1].clean_text == good and out[1].kept
    assert not out[2].kept and not out[2].base_failed
    assert not out[3].kept or out[3].clean_text


def test_empty_and_clashing(spark):
    assert quality_rules(empty(spark)).count() == 0
    twice = documents(spark).withColumnRenamed("lang", "kept").unionByName(documents(spark).withColumnRenamed("lang", "kept"))
    out = quality_rules(twice)
    assert out.columns.count("kept") == 1 and out.count() == 2 * len(DOCS)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=120), min_size=1, max_size=30))
def test_repeats_against_brute_force(spark, texts):
    out = quality_rules(documents(spark, [(i, t, "a") for i, t in enumerate(texts)])).select("doc_id", "n_repeat_words", "n_words").collect()
    assert {r.doc_id: (r.n_repeat_words, r.n_words) for r in out} == {i: (repeat_words(t), len(words(t))) for i, t in enumerate(texts)}
