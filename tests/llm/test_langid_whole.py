"""Profiles and the least likeness of the pipeline come from all training rows."""

import math
import random

from cellweave.llm import langid
from tests.llm.test_langid import SYLLABLES, code, slow_predict, slow_profiles, text


def test_profiles_and_least_likeness_take_every_row(spark):
    rng = random.Random(11)
    rows = [(i, text(x, rng, 6), x) for i, x in enumerate(rng.choices(list(SYLLABLES), k=4000))]
    rows += [(5000 + i, "жщ юэ " * 3, "aa") for i in range(9)]  # a few rows unlike the others
    train = langid.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    profiles = langid.fit_profiles(train, per_lang=None)
    want = slow_profiles(rows)
    assert profiles.langs == sorted(want)
    for i, x in enumerate(profiles.langs):
        assert {int(c): int(r) for c, r in zip(profiles.codes, profiles.rank[i]) if r >= 0} == {g: r for r, g in enumerate(want[x])}
    scores = sorted(slow_predict(want, r.text)[1] for r in train.collect())
    least = scores[math.ceil(0.001 * len(scores)) - 1]
    assert abs(langid.least_likeness(train, profiles) - 0.5 * least) <= 0.5 / langid.STEPS
    assert code("жщ") in want["aa"]
