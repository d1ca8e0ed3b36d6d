"""One sentence of a text read through another single-byte table, with words that are mostly ASCII."""

import random

from quillmark.llm.mojibake import find_garbled

VOCABULARY = "schön größe über müde straße können natürlich später wählen möchte haus garten und der die das mit von nicht auch wird dann zeit leben tag jahr hand wasser".split()


def test_single_odd_letters_in_plain_words_are_found(spark):
    rnd = random.Random(9)
    texts = [". ".join(" ".join(rnd.choice(VOCABULARY) for _ in range(12)) for _ in range(6)) for _ in range(1500)]
    rows, bad = [], {}
    for i, t in enumerate(texts):
        if i % 500 == 7:
            parts = t.split(". ")
            if sum(not c.isascii() for c in parts[2]) >= 3:
                bad[i] = t
                parts[2] = parts[2].encode("cp1252").decode("mac_roman")
                t = ". ".join(parts)
        rows.append((i, t))
    got = {r["doc_id"]: r["restored"] for r in find_garbled(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert len(bad) >= 2 and set(got) == set(bad), (len(bad), sorted(set(bad) ^ set(got)))
    assert [i for i in bad if got[i] != bad[i]] == []


def test_many_separate_passages_are_restored():
    """More passages than states of one search, with plain words between that the table would spoil."""
    import numpy as np

    from quillmark.llm import mojibake as J

    rnd = random.Random(3)
    sentence = lambda: " ".join([*(rnd.choice(VOCABULARY[:10]) for _ in range(6)), *(rnd.choice(VOCABULARY[10:]) for _ in range(4))]) + "."
    c = np.frombuffer("\n".join(sentence() for _ in range(4000)).encode("utf-32-le"), np.uint32)
    r = J.Repairer(np.bincount(J._pair_slots(c[:-1], c[1:]), minlength=J.PAIRS), np.bincount(c, minlength=J.SINGLES))
    text = [sentence() for _ in range(2 * J.POPS + 30)]
    bad = [s.encode("cp1252").decode("mac_roman") if i % 2 else s for i, s in enumerate(text)]
    got = [s.strip() + "." for s in r.repair(" ".join(bad)).split(".")][: len(text)]
    assert sum(a != b for a, b in zip(got, text)) <= 10  # one search of POPS states leaves 21 of 126
