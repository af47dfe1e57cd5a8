"""Dictionaries beyond the broadcast bound: the same hits, without Python in the plan."""

import random
from collections import Counter

from pyspark.sql import functions as F

from redactory.operators import dictionary as dic


def made(spark):
    rng = random.Random(4)
    words = ["ann", "Lee", "new", "York", "city", "élan", "日本", "x1", "a", "of"]
    terms = [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))), rng.choice(("PER", "LOC", "org"))) for _ in range(60)]
    terms += [("New-York  City", "GPE"), ("...", "PER"), ("", "PER"), (None, "PER"), ("ann", "PER"), ("ANN", "ORG")]
    gaps = [" ", "  ", ", ", "_", "\n", "-", "😀"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))
    texts = [(i % 3, text(rng.randint(0, 40))) for i in range(60)] + [(None, " " + text(700)), (7, None), (8, ""), (9, "😀" + text(64) + "ann"), (9, "ann")]
    return spark.createDataFrame(texts, "id int, note string"), spark.createDataFrame(terms, "term string, entity_type string")


def test_joined_hits_equal_hits_in_the_row(spark):
    texts, terms = made(spark)
    small = dic.gazetteer(texts, "id", "note", terms)
    for bounds in ({"max_rows": 0}, {"max_rows": 20}):
        large = dic.gazetteer(texts, "id", "note", terms, **bounds)
        assert large.columns == small.columns
        assert Counter(map(tuple, large.collect())) == Counter(map(tuple, small.collect()))
    assert small.where("`end` > 600").count() > 20
    wrong = small.join(texts, "id").where("text = substring(note, start + 1, `end` - start)").select("id", "start", "end", "text")
    assert wrong.distinct().count() >= small.select("id", "start", "end", "text").distinct().where("id IS NOT NULL").count()


def test_large_plan_has_no_python_and_no_copies(spark):
    texts, terms = made(spark)
    plan = dic.gazetteer(texts, "id", "note", terms, max_rows=0)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "_salt"))
    assert "_word" in plan and "SortMergeJoin" in plan or "Join Inner" in plan


def test_first_words_hold_all_lengths(spark):
    _, terms = made(spark)
    got = {r["_word"]: set(r["_lengths"]) for r in dic.first_words(dic.term_grams(terms)).collect()}
    for gram, n in dic.term_grams(terms).select("gram", "n").collect():
        assert n in got[gram.split(" ")[0]] and n == len(gram.split(" "))
    assert dic.term_grams(terms).where(F.col("gram") == "new york city").count() == 1


def test_words_that_begin_no_term_are_left_where_they_are(spark):
    texts, terms = made(spark)
    first = dic.first_words(dic.term_grams(terms))
    words = spark.range(20_000).selectExpr("concat('w', id) AS _word").union(first.select("_word"))
    kept = {r["_word"] for r in dic._possible(words, first).collect()}
    wanted = {r["_word"] for r in first.collect()}
    assert wanted <= kept and len(kept) < len(wanted) + 50


def test_a_text_is_shuffled_once_and_never_repeated(spark):
    texts, terms = made(spark)
    plan = dic.with_dictionary_spans(texts, "id", "note", terms, max_rows=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and "Aggregate [_digest" in plan and "first(note" not in plan
