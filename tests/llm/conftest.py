import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join(f"{rng.choice('abcdefg')}{rng.choice('aeiou')}{rng.randrange(words)}" for _ in range(n))


def many_texts():
    """Texts with what the operators must bear: nulls, empties, blanks, long texts, ties, copies, near copies, marks, other alphabets."""
    rng = random.Random(7)
    base, long = prose(rng, 120), prose(rng, 6000)
    near = base.split()
    near[60] = "changed"
    block = "\n".join(prose(rng, 12) for _ in range(6))
    texts = [
        None, "", " \n\t ", "one", "one two", "one two three", "One TWO three", base, base, base.upper(), " ".join(near), base.replace(" ", "  \n"), long, long + " tail", "é𝒳 ß " * 30, "a\x01b\x02c\n\x01\n\x02",
        "x@y.z " * 40, "mail me: jane.doe+x@mail-1.example.com, or 𝒳 call phone +1 (415) 555-2671 now", "card 4111 1111 1111 1111 and 4111111111111112 ip 10.0.0.255 and 300.1.1.1 1.2.3.4.5.6.7.8",
        "iban GB82 WEST 1234 5698 7654 32 bank", "IBAN GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789 and 123-45-6789", "password = 'hunter2hunter' token:abc secret=token: abcdefgh", "AKIA" + "A1" * 10 + " 𝒳 " + "0123456789abcdef" * 2, "-----BEGIN RSA PRIVATE KEY-----",
        "### *** $$$ %%% " * 40, "same line\nsame line\nsame line", "HELLO!! WORLD!! " * 40, block, "intro words here\n" + block + "\noutro words here", "other start\n" + block, "a b c a b c a b c " * 20,
    ]
    texts += [prose(rng, rng.randrange(1, 90)) for _ in range(60)]
    for k in range(12):  # a group of near copies of one long text
        w = long.split()
        w[100 * k + 5] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [base] * 30  # a hot group
    return texts


@pytest.fixture(scope="session")
def rows():
    return [(3 * i + 1, t, "en", [None, "s0", "s1", "s2", "s0", "s0"][i % 6], len(t or "")) for i, t in enumerate(many_texts())]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and columns whose names the operators use themselves."""
    rows = [(None, "a b c d", None, 1, "x"), (5, "a b c d", "s", 2, "y"), (5, "a b c d", "s", 2, "y"), (2**60 + 1, None, None, None, None), (7, "b\nb\nb c", "s", 3, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rid long, name string")
