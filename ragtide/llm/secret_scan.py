"""Secrets: patterns, and a battery of randomness tests on long tokens. DataFrame functions only.

Base kinds, leftmost without overlap, failing matches dropped: assign (a name such as password, then = or :, then 12
characters or more), access (AKIA and 14 or more capitals or digits), hex (16 or more of 0-9a-f). Their spans are whole
matches, in code points, the end exclusive.

Kind random: a token of 20 characters or more of an encoding, inferred from its characters (hex of either case, upper-case base32,
base64 with its URL form), that three tests do not tell from uniform symbols: chi-squared over the alphabet, the number of runs above
and below the middle, and the correlation of neighbours. Each is turned into a normal deviate whose tolerance is
Bonferroni-corrected. The discovery is "not ordinary text": for each token, the chance that text with the corpus's own
character frequencies would look as even as it does, from the mean and deviation of the chi-squared statistic at that
length. Candidate tokens are left out of these frequencies, so that random ones, however many, don't pass for ordinary
text. The chances are kept as logarithms, from a tail formula whose relative error is below 2e-7; they are ranked within
classes of length, by a histogram of fixed size, and Benjamini and Hochberg's rule bounds the share of false discoveries
in each class. Where no text but candidates has an encoding's symbols, nothing is known of ordinary text and no token of
that encoding is found. Tokens are cut out of the texts once and stored in the shared folder.

A null text counts as empty and gives no spans; rows may repeat; further columns are not touched; an empty table is
allowed. A token with too few distinct symbols fails the tests; ties of the chances get the same decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragtide.llm._store import Store

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: A shorter match of these two holds no longer one, so the least length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
TOKEN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*"

#: False discovery rate, and deviates beyond which a test rejects.
RATE, REJECT = 0.001, 3.2
BINS = 512
#: Symbols of a token that are turned into an array of numbers at once.
PIECE = 4096

_ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def located(text: str, pattern: str) -> Column:
    """array<struct<text, start>> of a pattern's matches. split() gives what lies between them; the ends are prefix sums
    of the lengths, by doubling, so that the work stays near the number of matches."""
    col = F.col(text)
    pair = F.array(F.struct(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)).alias("m"), F.split(col, pattern, -1).alias("g")))

    def place(x: Column) -> Column:
        sizes = F.transform(x["m"], lambda m, i: F.char_length(m).cast("long") + F.char_length(F.get(x["g"], i)))
        strides = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(x["m"]) + F.lit(1.0))).cast("int")), lambda e: F.pow(F.lit(2.0), e).cast("int"))
        ends = F.aggregate(strides, sizes, lambda acc, d: F.transform(acc, lambda v, i: v + F.when(i >= d, F.get(acc, i - d)).otherwise(F.lit(0))))
        return F.transform(F.arrays_zip(x["m"].alias("m"), ends.alias("e")), lambda y: F.struct(y["m"].alias("text"), (y["e"] - F.char_length(y["m"])).alias("start")))

    none = F.array().cast("array<struct<text:string,start:bigint>>")
    return F.when(col.rlike(pattern), F.flatten(F.transform(pair, place))).otherwise(none)


def _size_of_value(match: Column) -> Column:
    return F.char_length(F.regexp_extract(match, ASSIGN_VALUE, 1))


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with assign, access and hex: arrays of struct<text, start>."""
    return (
        df.withColumn("assign", F.filter(located(text, ASSIGN), lambda x: _size_of_value(x["text"]) >= 12))
        .withColumn("access", located(text, ACCESS))
        .withColumn("hex", located(text, HEX))
    )


def tokens(df: DataFrame, id_cols: list[str], text: str = "text") -> DataFrame:
    """A row for each token to be tested: id columns, token, start, encoding, alphabet size, plain (its
    symbols as the alphabet writes them), n (their number)."""
    found = df.select(*id_cols, F.explode(located(text, TOKEN)).alias("t")).select(
        *id_cols, F.rtrim(F.col("t.text"), F.lit("=")).alias("token"), F.col("t.start").alias("start")
    ).where("char_length(token) >= 20")
    enc = F.expr("CASE WHEN token RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 'hex' WHEN token RLIKE '^[A-Z2-7]+$' THEN 'base32' ELSE 'base64' END")
    return (
        found.withColumn("enc", enc)
        .withColumn("k", F.expr("CASE enc WHEN 'hex' THEN 16 WHEN 'base32' THEN 32 ELSE 64 END"))
        # Upper-case hex counts as lower-case; the URL form's - and _ as + and /.
        .withColumn("plain", F.expr("CASE enc WHEN 'hex' THEN lower(token) ELSE translate(token, '-_', '+/') END"))
        .withColumn("n", F.char_length("token"))
    )


def _by_enc(sql) -> str:
    """CASE with the SQL for each alphabet."""
    return "CASE enc " + " ".join(f"WHEN '{enc}' THEN {sql(a)}" for enc, a in _ALPHABETS.items()) + " END"


def _log_normal_tail(z: str) -> str:
    """ln P(Z < z) in SQL: for z < 0 a Chebyshev fit of the complementary error function (relative error below 1.2e-7 at every
    z), for z >= 0 from the other tail."""
    # The coefficients of the fit, from the constant on.
    fit = "-1.26551223 1.00002368 0.37409196 0.09678418 -0.18628806 0.27886807 -1.13520398 1.48851587 -0.82215223 0.17087277"
    sum_ = "0D"
    for c in reversed(fit.split()):
        sum_ = f"({c}D + t * {sum_})"
    lower = f"transform(array(1D / (1D + 0.5D * (abs({z}) / sqrt(2D)))), t -> ln(0.5D) + ln(t) - ({z}) * ({z}) / 2D + {sum_})[0]"
    return f"IF(({z}) < 0, {lower}, ln(1D - exp({lower})))"


def battery(toks: DataFrame) -> DataFrame:
    """With the tests' deviates z_chi, z_runs, z_serial and chi (the chi-squared statistic)."""
    # Lengths without each symbol, and strings of 0 and 1 for the lower and upper half of the alphabet, keep long tokens cheap.
    counts = _by_enc(lambda a: "array(" + ", ".join(f"n - octet_length(replace(plain, '{c}', ''))" for c in a) + ")")
    halves = _by_enc(lambda a: f"translate(plain, '{a}', '{'0' * (len(a) // 2) + '1' * (len(a) // 2)}')")
    high = "n - octet_length(replace(halves, '1', ''))"
    turns = "(2 * n - octet_length(replace(halves, '01', '')) - octet_length(replace(halves, '10', ''))) div 2"
    # Pieces of bounded size, each with the first symbol of the next one.
    pieces = f"regexp_extract_all(plain, '.{{1,{PIECE}}}', 0)"
    places = "transform(split(x, ''), c -> {} - 1)".format(_by_enc(lambda a: f"instr('{a}', c)"))
    products = "aggregate(transform(slice(v, 2, size(v)), (s, i) -> (s - (k - 1) / 2D) * (v[i] - (k - 1) / 2D)), 0D, (a, s) -> a + s)"
    serial = f"""aggregate(transform(pieces, (p, i) -> transform(array(concat(p, substring(coalesce(get(pieces, i + 1), ''), 1, 1))),
      x -> transform(array({places}), v -> {products})[0])[0]), 0D, (a, s) -> a + s)"""
    return (
        toks.withColumn("counts", F.expr(counts))
        .withColumn("halves", F.expr(halves))
        .withColumn("pieces", F.expr(pieces))
        .withColumn("chi", F.expr("aggregate(counts, 0D, (a, c) -> a + pow(c - n / CAST(k AS DOUBLE), 2D)) * k / n"))
        .withColumn("z_chi", F.expr("(pow(chi / (k - 1), 1D / 3) - (1 - 2D / (9 * (k - 1)))) / sqrt(2D / (9 * (k - 1)))"))
        .withColumn("hi", F.expr(high))
        .withColumn("runs", F.expr(f"1 + {turns}"))
        .withColumn("mu", F.expr("1 + 2D * hi * (n - hi) / n"))
        .withColumn("z_runs", F.expr("CASE WHEN hi = 0 OR hi = n THEN 99D ELSE (runs - mu) / sqrt(greatest(1e-9D, (mu - 1) * (mu - 2) / (n - 1))) END"))
        .withColumn("z_serial", F.expr(f"{serial} / ((k * CAST(k AS DOUBLE) - 1) / 12) / sqrt(n - 1D)"))
        .drop("counts", "halves", "pieces", "hi", "runs", "mu")
    )


def discoveries(tested: DataFrame, background: DataFrame) -> DataFrame:
    """tested with found: whether the token counts as random. background: enc, d, v (at most three rows): by how much
    ordinary text raises the chi-squared statistic a symbol, and its variance a symbol."""
    scored = tested.join(F.broadcast(background), "enc", "left").withColumn("z", F.expr("(chi - (k - 1) - n * d) / sqrt(2D * (k - 1) + n * v)"))
    scored = scored.withColumn("ln_p", F.expr(f"CASE WHEN d IS NULL THEN 0D ELSE {_log_normal_tail('z')} END"))
    # Classes by length double: 20-39, 40-79, ... Bins by the logarithm of p; at most 27 * BINS * 3 rows come of it.
    scored = scored.withColumn("len_class", F.expr("CAST(floor(log2(n / 20D)) AS INT)")).withColumn("bin", F.expr(f"CAST(least({BINS - 1}, floor(-8 * ln_p)) AS INT)"))
    hist = scored.groupBy("enc", "len_class", "bin").agg(F.count("*").alias("c"))
    cum = hist.selectExpr(
        "*",
        "sum(c) OVER (PARTITION BY enc, len_class ORDER BY bin DESC) AS upto",
        "sum(c) OVER (PARTITION BY enc, len_class) AS m",
    )
    # The largest p, so the lowest bin, whose upper bound exp(-bin/8) meets rank / m * RATE.
    cut = cum.where(f"exp(-bin / 8D) <= {RATE} * upto / m").groupBy("enc", "len_class").agg(F.min("bin").alias("cut"))
    even = F.expr(f"z_chi <= {REJECT} AND z_chi >= -{REJECT + 1} AND abs(z_runs) <= {REJECT} AND abs(z_serial) <= {REJECT}")
    return scored.join(F.broadcast(cut), ["enc", "len_class"], "left").withColumn("found", F.coalesce((F.col("bin") >= F.col("cut")) & even, F.lit(False)))


def background(docs: DataFrame, toks: DataFrame, text: str = "text") -> DataFrame:
    """d and v for each encoding (see discoveries()), from the frequencies of its symbols in all texts, those of candidate
    tokens (toks: token) taken off."""

    def symbols(df: DataFrame, column: str, sign: int) -> DataFrame:
        return df.select(F.explode(F.split(column, "")).alias("c")).groupBy("c").agg((sign * F.count("*")).cast("double").alias("x"))

    seen = symbols(docs, text, 1).union(symbols(toks, "token", -1)).groupBy("c").agg(F.sum("x").alias("x"))
    cells = ", ".join(f"struct('{enc}' AS enc, {len(a)}D AS k, '{a}' AS a)" for enc, a in _ALPHABETS.items())
    own = seen.where("x > 0").withColumn("e", F.expr(f"explode(array({cells}))")).where("contains(e.a, c)")
    sums = own.groupBy("e.enc", "e.k").agg(F.sum("x").alias("s1"), F.sum(F.pow("x", F.lit(2.0))).alias("s2"), F.sum(F.pow("x", F.lit(3.0))).alias("s3"))
    return sums.selectExpr("enc", "k * s2 / (s1 * s1) - 1 AS d", "4 * k * k * (s3 / pow(s1, 3D) - pow(s2 / (s1 * s1), 2D)) AS v")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_assign, n_access, n_hex, base and spans (kind:start:end, by start and then kind, comma-joined).

    Rows are told apart by id and text, so rows that repeat get the same result."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = src.withColumn("th", F.xxhash64("text"))
    toks = Store(docs.sparkSession, "secrets").put(tokens(keyed, ["id", "th"]), "tokens")
    found = discoveries(battery(toks), background(src, toks)).where("found")
    # The random tokens of one document: bounded by its own length.
    extra = found.groupBy("id", "th").agg(F.collect_set(F.struct("start", F.lit(3).alias("kind"), (F.col("start") + F.char_length("token")).alias("end"))).alias("extra"))
    own = base_spans(keyed).drop("text")

    def of_kind(k: int) -> Column:
        return F.transform(KINDS[k], lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), (x["start"] + F.char_length(x["text"])).alias("end")))

    out = own.select("id", "th", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.concat(*map(of_kind, range(3))).alias("base"))
    extra = extra.select(F.col("id").alias("xid"), F.col("th").alias("xth"), "extra")
    out = out.join(extra, out["id"].eqNullSafe(extra["xid"]) & (out["th"] == extra["xth"]), "left").drop("xid", "xth", "th")
    names = F.array(*map(F.lit, KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    all_spans = F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    return out.select("id", *[f"n_{k}" for k in KINDS[:3]], joined(F.col("base")).alias("base"), joined(all_spans).alias("spans"))
