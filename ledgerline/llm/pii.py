r"""Personal data in texts, by weak supervision, in DataFrame expressions only.

Candidates are spans of five kinds: email, ip, card, phone, and secret (a long run of letters and digits). Besides the
matches of the base rules, those that fail them count, and so do spelled-out addresses (`me at x dot org` in brackets)
and phone numbers in national form. Three labelers vote on each candidate, each from something else: a regex labeler
from the span's own form, a gazetteer labeler from lists (domain ends, issuer and country prefixes, private address
ranges, key prefixes) and a context labeler from the words before it. Expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability for each kind, and a logistic span classifier is trained on the
candidates' features with the resulting beliefs as soft labels. Spans of the base rules always stay; the classifier
adds any other candidate that it gives a probability of ADD_AT or more, whatever a single labeler says.

Base rules, leftmost and non-overlapping for each kind, failing matches dropped without another try:
email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`; ip four numbers of at most 255; card 14 to 19 digits, each
after at most one space or hyphen, passing Luhn; phone `\+[0-9][\x20().0-9-]+[0-9]` with 10 to 15 digits. The patterns
below say the same without repeated groups, on which Java's matcher would run out of stack in long texts, and try one
start for each run of characters, so that a long run takes linear time.

Null and empty texts have no spans. Positions are code points, ends are exclusive. Repeated rows are judged each for
itself; ties of start are ordered by kind, then end. The context of a span is what stands between it and the span of
its own form before it, at most 32 characters. Empty tables give empty results; extra columns stay, whatever their
names. Only counts by vote pattern and by feature pattern, both of fixed size, reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]

# Word lists of the gazetteer and context labelers.
DOMAIN_ENDS = "com org net edu gov io co info biz de fr es it nl uk us eu ch at be pl se no dk fi pt ru cn jp in br mx ca au"
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 358 380 420"
ISSUERS = "4 51 52 53 54 55 22 23 24 25 26 27 34 37 36 38 30 6011 65 35 62"
TRUNK_PREFIXES = "0 800 888 877 866 855 844 833 900"
SECRET_PREFIXES = "sk- pk- ghp_ gho_ xoxb- xoxp- AKIA ASIA AIza glpat-"
CONTEXT = {
    "email": "mail contact write to @",
    "ip": "ip host server address client remote",
    "card": "card visa credit debit payment iban account",
    "phone": "phone tel call mobile fax cell",
    "secret": "token secret password passwd pwd api key auth credential bearer",
}
AGAINST = "version release isbn issn commit checksum sha md5 build order invoice sku"
#: A candidate outside the base rules is added at this probability.
ADD_AT = 0.95


def _words(text: str, end: str = "") -> str:
    import re

    return "(?:" + "|".join(re.escape(w) for w in text.split()) + ")" + end


LOCAL = "[A-Za-z0-9._%+-]"
#: form -> (kind, what a text needs, what is searched, pattern). A text without what is needed (one of some signs, or a
#: short pattern) has no candidate and is not searched. In what is searched, characters that no match can hold are
#: replaced one for one.
FORMS = {
    "email": (0, ("@",), lambda t: F.regexp_replace(t, r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])", "%"), rf"(?:(?<!{LOCAL})|\G){LOCAL}+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"),
    "ip": (1, r"[0-9]\.[0-9]+\.[0-9]", lambda t: t, r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    "card": (2, "[0-9][0-9 -]{11}", lambda t: F.regexp_replace(t, r"(?<![0-9])[ -]|[ -](?![0-9])", "x"), r"[0-9][0-9 -]*[0-9]"),
    "phone": (3, ("+",), lambda t: t, r"\+[0-9][ ().0-9-]+[0-9]"),
    "secret": (4, "[A-Za-z0-9_-]{20}", lambda t: t, r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}"),
    # Any run of digits and phone signs; which of them are national numbers is told afterwards.
    "national": (3, "[0-9][0-9 ().-]{6}", lambda t: t, r"[+(]?[0-9][0-9 ().-]*[0-9]"),
    "spelled": (0, ("(at)", "[at]"), lambda t: t, rf"{LOCAL}+ ?[\[(]at[\])] ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]+){{1,4}}"),
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: The mark around matches, and what stands for it where a text holds it: neither can be part of a match.
MARK, OTHER = "\u0001", "\u0002"
NONE = "array<struct<start:int,end:int,m:string,before:string>>"


def placed(text: Column, form: str) -> Column:
    """The matches of a form: array of (start, end, m, before), before being at most 32 characters since the last match.

    One pass of the pattern sets marks around the matches; the text is then split at the marks, and running sums of the
    pieces' lengths tell where they stand.
    """
    _, needed, look, pattern = FORMS[form]
    unmarked = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)
    pieces = F.split(F.regexp_replace(look(unmarked), f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)

    def spans(p: Column, ends: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))
        return F.transform(at, lambda i: F.struct(F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("end"), F.get(p, i).alias("m"), F.right(F.get(p, i - 1), F.lit(32)).alias("before")))

    ends = lambda p: common.running(F.transform(p, F.length), lambda a, b: a + b, F.lit(0))
    found = common.bind(pieces, lambda p: F.when(F.size(p) > 2, common.bind(ends(p), lambda e: spans(p, e))).otherwise(F.array().cast(NONE)))
    has = text.rlike(needed) if isinstance(needed, str) else F.contains(text, F.lit(needed[0]))
    for sign in needed[1:] if isinstance(needed, tuple) else ():
        has = has | F.contains(text, F.lit(sign))
    return F.when(has, found).otherwise(F.array().cast(NONE))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def base(form: str, m: Column) -> Column:
    """Does a match pass the base rule of its kind?"""
    d = digits(m)
    if form == "email":
        return F.lit(True)
    if form == "ip":
        return m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if form == "card":
        return F.when(F.length(d).between(14, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False))
    if form == "phone":
        return F.length(d).between(10, 15)
    return F.lit(False)


def worth(form: str, s: Column) -> Column:
    """Is a match a candidate? A run of few digits is a number like any other, as is one that no phone would be written as."""
    m = s["m"]
    if form == "card":
        return F.length(digits(m)) >= 13
    if form == "phone":
        return F.length(digits(m)) >= 7
    if form == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    if form == "national":
        return m.rlike(r"^(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ -])[0-9]{3,5}[ -]?[0-9]{2,5}$") & F.length(digits(m)).between(8, 12) & ~F.substring(s["before"], -1, 1).rlike(r"[A-Za-z0-9+)]") & ~s["before"].rlike(r"\+[0-9]{1,3} ?$")
    return F.lit(True)


def formed(form: str, m: Column) -> Column:
    """The regex labeler: how well formed is the span in itself? 1, 0 (cannot say) or -1."""
    d, yes = digits(m), lambda c: F.when(c, 1).otherwise(-1)
    if form == "email":
        return yes(m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?!-)[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,24}$") & ~m.contains("..") & ~m.contains(".@"))
    if form == "ip":
        return yes(base(form, m) & ~m.rlike(r"(?:^|\.)0[0-9]"))
    if form == "card":
        return yes(base(form, m) & m.rlike(r"^(?:[0-9]+|[0-9]{4}(?:[ -][0-9]{4}){2,3}[ -][0-9]{1,4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"))
    if form == "phone":
        return yes(base(form, m) & ~d.rlike("^([0-9])\\1*$"))
    if form == "national":
        return yes(m.rlike(r"^(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}$|^0[0-9]{2,4}[ -][0-9]{3,5}[ -]?[0-9]{2,5}$"))
    if form == "spelled":
        return yes(m.rlike(r"(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,24}$"))
    mixed = m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9].*[0-9]")
    return yes(m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | mixed)


def listed(form: str, m: Column) -> Column:
    """The gazetteer labeler: 1, 0 (not on a list that says something) or -1."""
    yes = lambda c: F.when(c, 1).otherwise(-1)
    if form in ("email", "spelled"):
        return yes(F.lower(m).rlike(r"(?:\.|[\])] ?)" + _words(DOMAIN_ENDS, "$")))
    if form == "ip":
        return yes(~m.rlike(r"^(?:0|10|127|255)\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."))
    if form == "card":
        return yes(digits(m).rlike("^" + _words(ISSUERS)))
    if form == "phone":
        return yes(digits(m).rlike("^" + _words(COUNTRY_CODES)))
    if form == "national":
        return F.when(digits(m).rlike("^" + _words(TRUNK_PREFIXES)), 1).otherwise(0)
    return F.when(m.rlike("^" + _words(SECRET_PREFIXES)), 1).otherwise(0)


def told(kind: str, before: Column) -> Column:
    """The context labeler: 1, 0 (nothing said) or -1, from the words before."""
    low = F.lower(before)
    return F.when(low.rlike(r"\b" + _words(AGAINST) + r"\b[^A-Za-z]*[A-Za-z]{0,8}[^A-Za-z]*$"), -1).when(low.rlike(r"(?<![a-z])" + _words(CONTEXT[kind]) + r"(?![a-z])"), 1).otherwise(0)


def judge(form: str):
    """What becomes of a span (start, end, m, before): its votes and features."""
    i = FORMS[form][0]

    def judged(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"),
            F.lit(i).alias("kind"),
            s["end"].alias("end"),
            base(form, s["m"]).alias("base"),
            F.lit(list(FORMS).index(form)).alias("form"),
            formed(form, s["m"]).alias("regex"),
            listed(form, s["m"]).alias("gazetteer"),
            told(KINDS[i], s["before"]).alias("context"),
            F.least(F.floor((s["end"] - s["start"]) / 8), F.lit(6)).cast("int").alias("size"),
        )

    return judged


def candidates(text: Column) -> Column:
    """Array of (start, kind, end, base, form, regex, gazetteer, context, size) of a text, ordered by start, kind, end."""
    text = F.coalesce(text, F.lit(""))
    parts = [F.transform(F.filter(placed(text, form), lambda s: worth(form, s)), judge(form)) for form in FORMS]  # noqa: B023
    return F.array_sort(F.concat(*parts))


LABELERS = ("regex", "gazetteer", "context")
#: Starting rates of right votes, and bounds that keep the two classes from changing places.
START, LOW, HIGH = {"regex": 0.9, "gazetteer": 0.75, "context": 0.7}, 0.55, 0.99


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict, dict]:
    """patterns (kind, votes, count) -> belief for each (kind, votes), and (right on true, right on false) for each
    (kind, labeler): how often a labeler votes for a span that is personal data, and against one that isn't.

    Labelers err independently given the truth; a vote of 0 abstains and says nothing. Counts weigh patterns, with two
    imagined votes of the starting rate for each labeler and class.
    """
    beliefs, known = {}, {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = [(v, n) for k, v, n in patterns if k == kind]
        hit, miss, share = dict(START), dict(START), 0.5
        for _ in range(rounds):
            for votes, _n in own:
                yes, no = math.log(share), math.log(1 - share)
                for name, v in zip(LABELERS, votes, strict=True):
                    if v:
                        yes += math.log(hit[name] if v > 0 else 1 - hit[name])
                        no += math.log(1 - miss[name] if v > 0 else miss[name])
                beliefs[kind, votes] = 1 / (1 + math.exp(min(700, max(-700, no - yes))))
            for i, name in enumerate(LABELERS):
                cast = [(v[i] > 0, n, beliefs[kind, v]) for v, n in own if v[i]]
                for rates, right, weight in ((hit, True, lambda p: p), (miss, False, lambda p: 1 - p)):
                    all_ = sum(n * weight(p) for _, n, p in cast)
                    good = sum(n * weight(p) for up, n, p in cast if up == right)
                    rates[name] = min(HIGH, max(LOW, (good + 2 * START[name]) / (all_ + 2)))
            share = min(0.95, max(0.05, (sum(n * beliefs[kind, v] for v, n in own) + 1) / (sum(n for _, n in own) + 2)))
        known |= {(kind, name): (hit[name], miss[name]) for name in LABELERS}
    return beliefs, known


def features(kind: int, votes: tuple[int, ...], size: int) -> dict[tuple, float]:
    return {("kind", kind): 1.0, ("size", kind, size): 1.0} | {("vote", kind, i, v): 1.0 for i, v in enumerate(votes) if v}


def train(rows: list[tuple[int, tuple[int, ...], int, int]], beliefs: dict, rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[tuple, float]:
    """Weights of a logistic classifier on (kind, votes, size, count) rows, with beliefs as soft labels."""
    weights: dict[tuple, float] = {}
    total = {k: sum(n for kind, _, _, n in rows if kind == k) for k in {r[0] for r in rows}}
    for _ in range(rounds):
        slope: dict[tuple, float] = {}
        for kind, votes, size, n in rows:
            f = features(kind, votes, size)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(x, 0.0) for x in f)))))
            for x in f:
                slope[x] = slope.get(x, 0.0) + n / total[kind] * (beliefs[kind, votes] - p)
        for x, g in slope.items():
            weights[x] = weights.get(x, 0.0) + rate * (g - decay * weights.get(x, 0.0))
    return weights


def learn(found: DataFrame) -> dict[tuple[int, tuple[int, ...], int], float]:
    """Probability of each feature pattern (form, votes, size) among the candidates of found (_spans).

    Reliabilities are estimated by kind, so the forms of a kind share what is known of its labelers.
    """
    s = found.select(F.explode("_spans").alias("s"))
    keys = ["kind", "form", "regex", "gazetteer", "context", "size"]
    rows = s.groupBy(*(f"s.{k}" for k in keys)).count().orderBy(*keys).collect()
    kind = {r.form: r.kind for r in rows}
    rows = [(r.form, (r.regex, r.gazetteer, r.context), r["size"], r["count"]) for r in rows]
    by_votes: dict[tuple, int] = {}
    for form, votes, _, n in rows:
        by_votes[kind[form], votes] = by_votes.get((kind[form], votes), 0) + n
    beliefs, _ = reliabilities([(k, v, n) for (k, v), n in by_votes.items()])
    weights = train(rows, {(f, v): beliefs[kind[f], v] for f, v, _, _ in rows})
    return {(f, v, z): 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(x, 0.0) for x in features(f, v, z)))))) for f, v, z, _ in rows}


def accepted(spans: Column, model: dict, add_at: float = ADD_AT) -> Column:
    """(start, kind, end, base) of the base spans among candidates and of those that the classifier adds."""
    extra = [f * 1000 + (v[0] + 1) * 100 + (v[1] + 1) * 30 + (v[2] + 1) * 10 + z for (f, v, z), p in model.items() if p >= add_at]
    code = lambda s: s["form"] * 1000 + (s["regex"] + 1) * 100 + (s["gazetteer"] + 1) * 30 + (s["context"] + 1) * 10 + s["size"]
    kept = F.filter(spans, lambda s: s["base"] | (code(s).isin(extra) if extra else F.lit(False)))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row of docs (doc_id, text)."""
    found = common.settle(docs.select("doc_id", candidates(F.col("text")).alias("_spans")))
    return found.select("doc_id", accepted(F.col("_spans"), learn(found)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; of a span that reaches beyond those before it, the
    rest. Null texts stay null. Other columns stay as they are, whatever their names."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    found = common.settle(docs.select(row, candidates(F.col("text")).alias("_spans")))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col("_row.text")

    def written(spans: Column, tops: Column, of: Column) -> Column:
        """tops: how far the spans up to each one reach."""
        before = lambda i: F.when(i > 0, F.get(tops, i - 1)).otherwise(0)
        piece = lambda s, i: F.when(s["end"] > before(i), F.concat(common.cut(of, before(i), s["start"]), F.get(names, s["kind"]))).otherwise("")
        return F.concat(F.array_join(F.transform(spans, piece), ""), common.cut(of, F.element_at(tops, -1), F.length(text)))

    reach = lambda spans: common.running(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0))
    clean = common.bind(F.col("_kept"), lambda s: F.when(F.size(s) > 0, common.bind(reach(s), lambda tops: common.bind(common.blocks(text), lambda of: written(s, tops, of)))).otherwise(text))
    done = found.select("_row", accepted(F.col("_spans"), learn(found)).alias("_kept")).select("_row", clean.alias("_clean"))
    return done.select(*(F.col("_clean").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
