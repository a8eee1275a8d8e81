"""Operators do the whole job: nothing is sampled, cut or left out by size."""

import random

from veridane.llm import merkle, repetition

# --- Merkle ------------------------------------------------------------------


def test_likeness_of_long_texts_is_exact():
    """Texts of far more than 128 leaves: a few leaves in common, a few leaves changed, and repeated leaves."""
    r = random.Random(5)
    line = lambda: "".join(r.choice("acegijklnopqstuvwxyz") for _ in range(15))  # noqa: E731  one leaf, as it is too short to be cut
    like = lambda x, y: merkle.likeness(*[merkle.fingerprint(merkle.tree("\n".join(t))) for t in (x, y)])
    shared, a, b = ([line() for _ in range(n)] for n in (6, 594, 594))
    assert like(a + shared, b + shared) == 6 / 600
    long = [line() for _ in range(5000)]
    edited = [line() if k % 1000 == 0 else x for k, x in enumerate(long)]
    assert like(long, edited) == 4995 / 5000
    assert like(shared[:1] * 300, shared[:1] * 100) == 2 * 100 / 400


# --- quality -----------------------------------------------------------------


def test_longest_repeat_is_exact():
    """Against all windows of words, with repeats below and above the limit; SQL and the other tests leave the length out."""
    r = random.Random(12)
    word = lambda: r.choice("abcdefgh")
    texts = [None, "", "a", "a b", "a a", "a a a a", *[" ".join(word() for _ in range(r.randint(0, 80))) for _ in range(60)]]
    for n in (5, 49, 50, 51, 60):
        passage = " ".join(f"p{k}" for k in range(n))
        texts += [f"x {passage} y {passage} z", f"{passage} {passage}"]

    def longest(t):
        w = (t or "").split()
        return max((k for k in range(1, len(w)) if len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) < len(w) - k + 1), default=0)

    got = repetition.measure(texts)["longest_repeat"]
    assert [int(x) for x in got] == [longest(t) for t in texts]
