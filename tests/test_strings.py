import pytest

import ragtide as rt

WORDS = ["ab c ab", "  pad\t", "Abc Def", "12", None, "é", "", "x-y"]
PYTHON = {
    "capitalize": lambda s: s.capitalize(),
    "swapcase": lambda s: s.swapcase(),
    "title": lambda s: s.title(),
    "is_alnum": lambda s: s.isalnum(),
    "is_alpha": lambda s: s.isalpha(),
    "is_ascii": lambda s: s.isascii(),
    "is_decimal": lambda s: s.isdecimal(),
    "is_digit": lambda s: s.isdigit(),
    "is_lower": lambda s: s.islower(),
    "is_numeric": lambda s: s.isnumeric(),
    "is_printable": lambda s: s.isprintable(),
    "is_space": lambda s: s.isspace(),
    "is_title": lambda s: s.istitle(),
    "is_upper": lambda s: s.isupper(),
    "length": len,
    "lower": lambda s: s.lower(),
    "upper": lambda s: s.upper(),
    "reverse": lambda s: s[::-1],
    "trim_whitespace": lambda s: s.strip(),
    "ltrim_whitespace": lambda s: s.lstrip(),
    "rtrim_whitespace": lambda s: s.rstrip(),
}
WITH = [
    ("count_substring", ("ab",), {}, lambda s: s.count("ab")),
    ("ends_with", ("ab",), {}, lambda s: s.endswith("ab")),
    ("starts_with", ("AB",), {"ignore_case": True}, lambda s: s.lower().startswith("ab")),
    ("find_substring", ("c",), {}, lambda s: s.find("c")),
    ("lpad", (7, "*"), {}, lambda s: s.rjust(7, "*")),
    ("rpad", (3, "*"), {}, lambda s: s.ljust(3, "*")),
    ("match_substring", (".",), {}, lambda s: "." in s),
    ("repeat", (2,), {}, lambda s: s * 2),
    ("replace_substring", ("ab", "$1"), {"max_replacements": 1}, lambda s: s.replace("ab", "$1", 1)),
    ("replace_slice", (1, 3, "ZZ"), {}, lambda s: s[:1] + "ZZ" + s[3:]),
    ("slice", (0, -1, 2), {}, lambda s: s[0:-1:2]),
    ("slice", (-3,), {}, lambda s: s[-3:]),
    ("slice", (None, None, -1), {}, lambda s: s[::-1]),
    ("split_pattern", (" ",), {"max_splits": 1, "reverse": True}, lambda s: s.rsplit(" ", 1)),
    ("split_pattern", (".",), {}, lambda s: s.split(".")),
    ("trim", ("a ",), {}, lambda s: s.strip("a ")),
    ("ltrim", ("a",), {}, lambda s: s.lstrip("a")),
    ("rtrim", ("b",), {}, lambda s: s.rstrip("b")),
    ("is_in", (["12", "é"],), {}, lambda s: s in ("12", "é")),
]


@pytest.fixture(scope="module")
def words(spark):
    return rt.from_lists([WORDS[:4], WORDS[4:]], spark=spark)


@pytest.mark.parametrize("name", PYTHON)
def test_like_python(name, words):
    assert getattr(rt.str, name)(words).compute() == [None if s is None else PYTHON[name](s) for s in WORDS]


@pytest.mark.parametrize("case", WITH, ids=lambda c: c[0])
def test_with_arguments(case, words):
    name, args, options, fn = case
    expected = [(False if name == "is_in" else None) if s is None else fn(s) for s in WORDS]
    assert getattr(rt.str, name)(words, *args, **options).compute() == expected


def test_regexes(words):
    assert rt.str.count_substring_regex(words, "[a-c]").compute() == [5, 1, 2, 0, None, 0, 0, 0]
    assert rt.str.find_substring_regex(words, "c.").compute() == [3, -1, 2, -1, None, -1, -1, -1]
    assert rt.str.match_substring_regex(words, "^a").compute()[:3] == [True, False, False]
    assert rt.str.replace_substring_regex(words, "([ab])", r"<\1>", 2).compute()[:2] == ["<a><b> c ab", "  p<a>d\t"]
    assert rt.str.extract_regex(words, r"(?P<aa>[a-z])(?P<b_b>.)").compute()[:4] == [{"aa": "a", "b_b": "b"}, {"aa": "p", "b_b": "a"}, {"aa": "b", "b_b": "c"}, None]
    assert rt.str.match_like(words, "%b_", ignore_case=True).compute()[0] is False
    assert rt.str.split_pattern_regex(words, "[ -]", 1).compute()[0] == ["ab", "c ab"]


def test_missing_in_value_sets(words):
    assert rt.str.is_in(words, ["12", None]).compute() == [False, False, False, True, True, False, False, False]
    assert rt.str.is_in(words, ["12", None], skip_nones=True).compute()[4] is False
    assert rt.str.index_in(words, ["12", "é", "12"]).compute() == [None, None, None, 0, None, 1, None, None]


def test_nested_and_joined(spark):
    lists = rt.from_lists([[["a", "b"], ["c", None], [], None]], spark=spark)
    assert rt.str.join(lists, "-").compute() == ["a-b", None, "", None]
    assert rt.str.upper(lists).compute() == [["A", "B"], ["C", None], [], None]
    assert rt.str.split_pattern(rt.from_lists([[["a b"]]], spark=spark), " ").compute() == [[["a", "b"]]]
    r = rt.from_lists([[{"l": ["a", "b"], "s": "+"}, {"l": ["c"], "s": "/"}]], spark=spark)
    assert rt.str.join(r.l, r.s).compute() == ["a+b", "c"]
    assert rt.str.join_element_wise(r.s, r.s, "_").compute() == ["+_+", "/_/"]
    assert rt.str.center(r.s, 4, "*").compute() == ["*+**", "*/**"]
