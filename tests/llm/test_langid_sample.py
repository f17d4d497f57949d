"""Languages are learned from the whole of the sampled texts."""

import random

from loomtide.llm import langid


def test_what_opens_a_text_does_not_hide_the_rest(spark):
    """One language's texts open with digits, two share a long opening, one has few letters."""
    r = random.Random(6)
    words = {lang: ["".join(r.choice(letters) for _ in range(6)) for _ in range(40)] for lang, letters in (("aa", "abcdefgh"), ("bb", "ijklmnop"), ("cc", "qrstuvwx"), ("dd", "yzåäöüßé"))}
    shared = "licensed under the terms of the license " * 8
    opening = {"aa": "0123 - 456. " * 40, "bb": shared, "cc": shared, "dd": ""}

    def text(lang):
        gap = " 0.12 | 345 ;" * (30 if lang == "dd" else 0)
        return opening[lang] + " ".join(r.choice(words[lang]) + gap for _ in range(80))

    rows = [(100 * k + i, text(lang), lang) for k, lang in enumerate(words) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    learned = langid.sample(docs)
    assert sorted(learned) == sorted(words)
    for lang, said in learned.items():
        assert len(set(said.split()) & set(words[lang])) > 30
        assert len(said) <= langid.SAMPLE_DOCS * (langid.SAMPLE_CHARS + langid.PIECES)
    alone = spark.createDataFrame([(i, " ".join(r.choice(words[lang]) for _ in range(20))) for i, lang in enumerate(words)], "doc_id long, text string")
    train = docs.unionByName(alone.selectExpr("doc_id + 9000 as doc_id", "text", "cast(null as string) as lang"))
    assert [x["lang_pred"] for x in langid.identify(train).where("doc_id >= 9000").orderBy("doc_id").collect()] == list(words)
