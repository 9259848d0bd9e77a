import random

from postlytics.llm import language


def _words(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(n))


def test_a_rare_language_is_learnt_from_all_its_texts(spark):
    rng = random.Random(1)
    rows = [(_words(rng, "abcdefgh", 12), "much") for _ in range(3000)] + [(_words(rng, "αβγδεζηθ", 12), "rare") for _ in range(12)]
    model = language.fit_languages(spark.createDataFrame(rows, "text string, lang string"), sample=60)
    lang, _, known = model.predict(_words(rng, "αβγδεζηθ", 12))
    assert lang == "rare" and known >= language.LEAST_KNOWN
    assert model.predict(_words(rng, "abcdefgh", 12))[0] == "much"


def test_more_languages_than_a_filter_word_holds(spark):
    rng = random.Random(2)
    letters = {f"l{i:03}": "".join(chr(0x4E00 + 8 * i + k) for k in range(8)) for i in range(130)}
    rows = [(_words(rng, some, 60), lang) for lang, some in letters.items() for _ in range(3)]
    model = language.fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == sorted(letters) and model.table.shape == (3, language.SLOTS)
    assert [model.predict(_words(rng, some, 60))[0] for some in letters.values()] == list(letters)
