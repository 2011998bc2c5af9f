"""Secret scans: patterns, and a battery of randomness tests on other tokens.

Three patterns (values assigned to names such as password or token, access key ids, runs
of hex digits) give the base spans.  Every other token of letters, digits and the signs
of base64 that holds a letter is a candidate, a value after "=" too.  Its encoding is inferred from
the characters it has (hex in groups, as in UUIDs, is tested without the signs between);
against uniform random text over that alphabet four tests run: chi-squared of the
character counts, chi-squared of vowels, other letters of either case and other signs
(few cells, so that short tokens are told apart), runs above and below the alphabet's
middle, and serial correlation of neighbours.  Fisher's method combines them.

Random tokens have uniform probabilities, natural ones low ones, and how low depends on
length and encoding.  So false discoveries, natural tokens taken for secrets, are controlled for each
encoding and class of lengths over the whole corpus: the upper tail tells how many random
tokens there are, and the cut is the least probability from which on all but a share
``FALSE`` of the candidates are random (and never below ``RATE``, the share of random
tokens that is given up).  Their histogram is of bounded size.

All of it is column expressions; nothing runs in Python on the executors.

Defined results: null counts as empty and has no spans; spans are half-open code point
offsets; spans of one kind don't overlap, those of different patterns may; equal texts, and rows that repeat,
have equal spans; texts are read whole, in time nearly linear in their length (running sums and maxima go by blocks); an empty table gives no rows; columns of the input
named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.llm._common import materialize, table
from concordia.llm.fingerprint import let

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Failing matches hold no later one that passes, so these two ask for the length at once.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS, ASSIGN_CHARS = ("assign", "access", "hex", "random"), 12
#: Runs that may be encoded bytes, whole ones (a value may follow "="); the lookahead asks for a letter within.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Hex digits of one case in groups.
GROUPED = "^(?:[0-9A-F]+(?:-[0-9A-F]+)+|[0-9a-f]+(?:-[0-9a-f]+)+)$"
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings by the pattern of their characters, in the order in which they are tried, with their alphabets.
ENCODINGS = (
    ("hex", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", _LOWER),
    ("upper", "^[A-Z]+$", _UPPER),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOWER),
    ("base36", "^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("letters", "^[A-Za-z]+$", _UPPER + _LOWER),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", "^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)
ANY = _UPPER + _LOWER + _DIGITS + "+/-_"
NAMES = (*dict.fromkeys(name for name, _, _ in ENCODINGS), "mixed")
_VOWELS = "aeiouAEIOU"
#: Share of random tokens given up at least; share of natural tokens among the discoveries; cells of the histogram for each factor of ten.
RATE, FALSE, CELLS, MOST_CELLS = 0.02, 0.1, 20, 400
#: Cells up to which all candidates count for the number of random ones (probabilities from 0.71 to 0.45 on); classes of lengths.
UPPER_CELLS, LENGTHS = range(2, 7), 61
#: Values of a block of running sums; code points of a piece of text that is cut by position.
RUN, PIECE = 128, 4096


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The values so far put together by ``step``, at each place; by blocks, and over the blocks."""

    def within(block: Column) -> Column:
        return F.transform(block, lambda _, i: F.aggregate(F.slice(block, F.lit(1), i + 1), zero, step))

    def blocks(all_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int"))
        return F.transform(starts, lambda k: within(F.slice(all_, k * RUN + 1, F.lit(RUN))))

    def joined(parts: Column) -> Column:
        ends = F.transform(parts, lambda part: F.element_at(part, -1))
        before = lambda e: F.transform(e, lambda _, i: F.when(i > 0, F.aggregate(F.slice(e, F.lit(1), i), zero, step)).otherwise(zero))
        return F.flatten(F.zip_with(parts, let(ends, before), lambda part, b: F.transform(part, lambda x: step(b, x))))

    return F.when(F.size(values) > 0, let(let(values, blocks), joined)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    """start, end and text of all leftmost matches that don't overlap, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)

    def place(x: Column) -> Column:
        steps = F.zip_with(x["found"], F.slice(x["gaps"], F.lit(1), F.size(x["found"])), lambda one, gap: F.length(one) + gap)
        ends = running(steps, F.lit(0), lambda a, b: a + b)
        return F.zip_with(x["found"], ends, lambda one, end: F.struct((end - F.length(one)).alias("start"), end.alias("end"), one.alias("value")))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), let(F.struct(found.alias("found"), between.alias("gaps")), place)).otherwise(none)


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` (in order, none overlapping another) that overlap none of ``others`` (in order of their starts)."""

    def events(x: Column) -> Column:
        starts = F.transform(x["others"], lambda o: F.struct(o["start"].alias("at"), F.lit(1).alias("kind")))
        ends = F.transform(x["spans"], lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("kind")))
        order = F.transform(F.array_sort(F.concat(starts, ends)), lambda e, i: F.struct(e["kind"].alias("kind"), i.alias("i")))
        # how many others start before each span's end
        before = F.transform(F.filter(order, lambda e: e["kind"] == 0), lambda e, j: e["i"] - j)
        furthest = running(F.transform(x["others"], lambda o: o["end"]), F.lit(0), lambda a, b: F.greatest(a, b))

        def kept(y: Column) -> Column:
            clear = F.zip_with(x["spans"], y["before"], lambda s, n: F.struct(s.alias("s"), (F.when(n > 0, F.get(y["furthest"], n - 1)).otherwise(0) <= s["start"]).alias("clear")))
            return F.transform(F.filter(clear, lambda c: c["clear"]), lambda c: c["s"])

        return let(F.struct(before.alias("before"), furthest.alias("furthest")), kept)

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(F.struct(spans.alias("spans"), others.alias("others")), events))


def _tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, by a logistic of a cubic (error below 0.0002), clipped to 1e-18."""
    return let(F.least(F.lit(12.0), F.greatest(F.lit(-12.0), z)), lambda v: F.greatest(F.lit(1e-18), 1 / (1 + F.exp(v * 1.5976 + 0.070565992 * v * v * v))))


def _battery(token: Column, alphabet: Column) -> Column:
    """Combined probability that uniform text over the alphabet looks at least as unlike it as the token.

    Each step binds its values once, so the expression stays small.
    """
    start = F.struct(
        token.alias("t"),
        F.length(token).cast("double").alias("n"),
        F.length(alphabet).cast("double").alias("size"),
        F.split(alphabet, "").alias("letters"),
        F.transform(F.split(token, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double")).alias("index"),
    )

    def pools(of: Column) -> Column:
        """How many vowels, other lower-case and upper-case letters, and other signs there are."""
        without = lambda chars: F.length(F.translate(of, chars, ""))
        rest = lambda letters: "".join(c for c in letters if c not in _VOWELS)
        every = F.length(of)
        return F.transform(F.array(every - without(_VOWELS), every - without(rest(_LOWER)), every - without(rest(_UPPER)), without(_LOWER + _UPPER)), lambda x: x.cast("double"))

    def counts(s: Column) -> Column:
        squares = F.aggregate(s["letters"], F.lit(0.0), lambda h, c: h + F.pow(s["n"] - F.length(F.replace(s["t"], c, F.lit(""))), F.lit(2.0)))
        last = F.size(s["index"]) - 1
        pairs = F.arrays_zip(F.slice(s["index"], F.lit(1), last).alias("a"), F.slice(s["index"], F.lit(2), last).alias("b"))
        high = F.size(F.filter(s["index"], lambda i: i >= s["size"] / 2)).cast("double")
        seen, all_ = pools(s["t"]), pools(alphabet)
        coarse = F.zip_with(seen, all_, lambda o, a: F.when(a > 0, F.pow(o - s["n"] * a / s["size"], F.lit(2.0)) / (s["n"] * a / s["size"])).otherwise(0.0))
        found = F.struct(
            s["n"].alias("n"), s["size"].alias("size"), squares.alias("squares"), pairs.alias("pairs"), high.alias("high"),
            F.aggregate(coarse, F.lit(0.0), lambda h, x: h + x).alias("coarse"), (F.size(F.filter(all_, lambda a: a > 0)) - 1).cast("double").alias("free"),
        )
        return let(found, scores)

    def scores(s: Column) -> Column:
        n, size = s["n"], s["size"]

        def uneven(chi: Column, free: Column) -> Column:
            # Wilson and Hilferty's cube root makes chi-squared nearly normal
            spread = 2 / (9 * free)
            return (F.pow(F.greatest(F.lit(0.0), chi) / free, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)

        runs = F.size(F.filter(s["pairs"], lambda p: (p["a"] >= size / 2) != (p["b"] >= size / 2))) + 1
        mixed = 2 * s["high"] * (n - s["high"])
        variance = mixed * (mixed - n) / (n * n * (n - 1))
        of_runs = F.when(variance > 0, F.abs(runs - mixed / n - 1) / F.sqrt(variance)).otherwise(F.lit(12.0))
        product = F.aggregate(s["pairs"], F.lit(0.0), lambda h, p: h + (p["a"] - (size - 1) / 2) * (p["b"] - (size - 1) / 2))
        serial = F.abs(product) / ((size * size - 1) / 12 * F.sqrt(n - 1))
        twice = lambda z: F.least(F.lit(1.0), 2 * _tail(z))
        of_letters, of_pools = _tail(uneven(s["squares"] * size / n - n, size - 1)), _tail(uneven(s["coarse"], s["free"]))
        # Fisher: the upper tail of chi-squared with eight degrees of freedom at 2x
        return let(-(F.log(of_letters) + F.log(of_pools) + F.log(twice(of_runs)) + F.log(twice(serial))), lambda x: F.exp(-x) * (1 + x + x * x / 2 + x * x * x / 6))

    return let(start, counts)


def candidate(found: Column) -> Column:
    """start, end, length, encoding (its place in NAMES) and probability of a candidate."""
    token = F.rtrim(found["value"], F.lit("="))
    token = F.when(token.rlike(GROUPED), F.upper(F.replace(token, F.lit("-"), F.lit("")))).otherwise(token)

    def tested(t: Column) -> Column:
        encoding = F.struct(F.lit(NAMES.index("mixed")).alias("name"), F.lit(ANY).alias("alphabet"))
        for kind, pattern, alphabet in reversed(ENCODINGS):
            encoding = F.when(t.rlike(pattern), F.struct(F.lit(NAMES.index(kind)).alias("name"), F.lit(alphabet).alias("alphabet"))).otherwise(encoding)
        return let(encoding, lambda e: F.struct(found["start"].alias("start"), found["end"].alias("end"), F.length(t).alias("chars"), e["name"].alias("encoding"), _battery(t, e["alphabet"]).alias("p")))

    return let(token, tested)


def _cell(p: Column) -> Column:
    return F.least(F.lit(MOST_CELLS), F.floor(-F.log10(F.greatest(p, F.lit(1e-40))) * CELLS)).cast("int")


def _kind(c: Column) -> Column:
    """The encoding and the class of lengths as one number."""
    return c["encoding"] * LENGTHS + F.least(F.lit(LENGTHS - 1), F.floor(F.log2(F.greatest(c["chars"], F.lit(1)).cast("double")) * 2)).cast("int")


def cut_of(cells: dict[int, int]) -> int:
    """The last cell whose candidates are discoveries, -1 if none are: cell c holds probabilities above 10^-((c + 1) / CELLS)."""
    least = lambda c: 10 ** (-(c + 1) / CELLS)
    upto = {c: sum(n for k, n in cells.items() if k <= c) for c in range(max(UPPER_CELLS) + 1 + CELLS * 2)}
    # natural tokens in the upper tail only raise these, so the least counts; up to one more, for none may have come up,
    # but less the more natural tokens there are, of which some come high too
    more = 1 / (1 + sum(n for c, n in cells.items() if least(c) < RATE) / 10)
    random = min((upto[c] + more) / (1 - least(c)) for c in UPPER_CELLS)
    fine = [c for c, n in upto.items() if least(c) >= RATE and n and 1 - random * (1 - least(c)) / n <= FALSE]
    return max(fine, default=-1)


def cuts(scanned: DataFrame) -> dict[int, int]:
    """The cut of each encoding and class of lengths; at most len(NAMES) * LENGTHS of them."""
    tokens = scanned.select(F.explode("candidates").alias("c")).select(_kind(F.col("c")).alias("kind"), _cell(F.col("c.p")).alias("cell"))
    counts: dict[int, dict[int, int]] = {}
    # at most len(NAMES) * LENGTHS * (MOST_CELLS + 1) rows, whatever the corpus
    for row in tokens.groupBy("kind", "cell").count().collect():
        counts.setdefault(row["kind"], {})[row["cell"]] = row["count"]
    return {kind: cut_of(cells) for kind, cells in counts.items()}


def scan(docs: DataFrame, *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base and spans (arrays of start, kind, end in order).

    Without ``keep_text`` the text column goes, and only slim rows are written between the two steps.
    """
    docs = docs.drop("n_assign", "n_access", "n_hex", "base", "spans", "candidates")
    text = F.coalesce(F.col(text_col), F.lit(""))
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
    assigned = F.filter(F.zip_with(matches(text, ASSIGN), F.when(text.rlike(ASSIGN), values).otherwise(F.array().cast("array<string>")), lambda m, v: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.length(v).alias("chars"))), lambda m: m["chars"] >= ASSIGN_CHARS)
    found = docs.withColumns({"__a": assigned, "__k": matches(text, ACCESS), "__h": matches(text, HEX), "__c": matches(text, CANDIDATE)})
    span = lambda kind: lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    base = F.array_sort(F.concat(*[F.transform(c, span(k)) for k, c in enumerate(("__a", "__k", "__h"))]))
    found = found.select(
        *[F.col(c) for c in docs.columns if keep_text or c != text_col],
        *[F.size(c).cast("long").alias(n) for c, n in (("__a", "n_assign"), ("__k", "n_access"), ("__h", "n_hex"))],
        base.alias("base"),
        F.col("__c"),
    )
    found = materialize(found.withColumn("candidates", F.transform(apart(F.col("__c"), F.col("base")), candidate)).drop("__c"), "scanned")
    limits = cuts(found)
    cut = F.array(*[F.lit(limits.get(kind, -1)) for kind in range(max(limits, default=0) + 1)])
    random = F.filter("candidates", lambda c: _cell(c["p"]) <= F.get(cut, _kind(c)))
    random = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), c["end"].alias("end")))
    return found.withColumn("spans", F.array_sort(F.concat("base", random))).drop("candidates")


def written(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each stretch that spans cover replaced by the mark."""

    def cut(x: Column, start: Column, stop: Column) -> Column:
        # a position in a whole text would be counted from its beginning each time
        part = lambda k: F.coalesce(F.get(x["parts"], k), F.lit(""))
        first, last = F.floor(start / PIECE).cast("int"), F.floor(stop / PIECE).cast("int")
        one = F.substring(part(first), start % PIECE + 1, stop - start)
        many = F.concat(F.substring(part(first), start % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(x["parts"], first + 2, F.greatest(F.lit(0), last - first - 1)), ""), F.substring(part(last), F.lit(1), stop % PIECE))
        return F.when(first == last, one).otherwise(many)

    def put(x: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(x["ends"], i - 1)).otherwise(0)
            return F.when(s["start"] >= before, F.concat(cut(x, before, s["start"]), F.lit(mark))).otherwise("")

        return F.concat(F.array_join(F.transform(x["spans"], piece), ""), cut(x, F.element_at(x["ends"], -1), x["chars"]))

    parts = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))
    ends = running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
    bound = F.struct(parts.alias("parts"), spans.alias("spans"), ends.alias("ends"), F.length(text).alias("chars"))
    return F.when(F.size(spans) == 0, text).otherwise(let(bound, put))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the spans of every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
