import random

from labelflow.functions import text as X


def test_strip_matches_python(values):
    rng = random.Random(1)
    alphabet = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0　 ax臺０"
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    assert values(X.ustrip, samples) == [s.strip() for s in samples]


def test_lines_match_python(values):
    rng = random.Random(2)
    alphabet = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  ab臺\x1f"
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 15))) for _ in range(300)]
    kept = [[x for x in lines if x] for lines in values(X.split_lines, samples)]
    assert kept == [[x for x in s.splitlines() if x] for s in samples]


def test_digits_of_all_scripts(values):
    assert values(X.ascii_digits, ["４2", "٣", "x"]) == ["42", "3", "x"]


def test_preview_cuts_characters_only_when_longer(values):
    assert values(lambda c: X.preview(c, 3), ["臺北市", "臺北市區", "a", None]) == ["臺北市", "臺北市...", "a", None]


def test_caps_and_stems(values):
    assert values(lambda c: X.cap_words(c, 2), ["a b c", "a"]) == ["a b", "a"]
    assert values(X.parse_level, ["4-酸", "12-x"]) == [4, 12]
    assert values(X.file_stem, ["/x/y.z/results_1.csv", "plain", "a.b.csv"]) == ["results_1", "plain", "a.b"]
