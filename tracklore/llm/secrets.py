"""Secret scans through a trigram inverted index; DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: a disjunction of conjunctions of trigrams that
every match must hold in lower case. Of a conjunction the first and the last trigram are asked for: the ones between
add little, and each costs a pass over all texts. The index has a posting list for each trigram that some query names,
in blocks of documents, so that no list is gathered whole. Queries are answered by intersecting the lists of a block;
the candidates are verified by the regular expression itself, with positions. Rules without mandatory trigrams are
verified on every text.

Positions come from the pieces between matches: regular expressions split the text and extract the matches, and running
sums of lengths give the offsets in characters.

Defined results: null and empty texts hold nothing; very long texts are scanned whole; matches of one rule do not overlap,
those of different rules may; rows with the same doc_id are each verified by their own text (their candidates are shared);
rows without doc_id are scanned for all rules; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re._parser as grammar
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch

#: Candidates of at most so many documents are broadcast (some 60 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
MAX_ALTERNATIVES = 64
#: Postings of a block of documents, about.
BLOCK_POSTINGS = 1 << 16


@dataclass(frozen=True)
class Rule:
    """pattern: regular expression; value_group, least: matches whose group has fewer characters are dropped after
    they were consumed. base: one of the three kinds that count by themselves."""

    name: str
    pattern: str
    value_group: int = 0
    least: int = 0
    base: bool = False


#: Public key formats and the assignment form.
RULES = (
    Rule("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)


def _runs(tree) -> list[list[str | None]]:
    """Alternatives of an expression as lists of letters; None: anything may stand here."""
    out: list[list[str | None]] = [[]]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            found: list[list[str | None]] = [[chr(arg).lower()]]
        elif name == "SUBPATTERN":
            found = _runs(arg[3])
        elif name == "BRANCH":
            found = [x for part in arg[1] for x in _runs(part)]
        elif name == "IN" and len(arg) <= 8 and all(str(o) == "LITERAL" for o, _ in arg):
            found = [[chr(a).lower()] for _, a in arg]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[1] == 1 and arg[0] == 0:
            found = [[], *_runs(arg[2])]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and 1 <= arg[0] <= 3:
            once = _runs(arg[2])
            found = [[y for x in p for y in x] + ([] if arg[0] == arg[1] else [None]) for p in product(once, repeat=arg[0])]
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            found = [[]]
        else:
            found = [[None]]
        if len(out) * len(found) > MAX_ALTERNATIVES:
            found = [[None]]
        out = [a + b for a in out for b in found]
    return out


def trigram_query(pattern: str) -> list[list[str]] | None:
    """Alternatives, each a list of trigrams that all occur in a match, in lower case; None where an alternative has none."""
    # a group's own flag changes only the case of what matches, and all is compared in lower case
    alternatives = set()
    for letters in _runs(grammar.parse(pattern.replace("(?i)", ""))):
        text = "".join("\0" if x is None else x for x in letters)
        grams = [g for g in (text[i : i + 3] for i in range(len(text) - 2)) if "\0" not in g and g.isascii()]
        alternatives.add(frozenset((grams[0], grams[-1])) if grams else frozenset())
    # an alternative that asks for more than another adds nothing
    least = [a for a in alternatives if not any(b < a for b in alternatives)]
    return None if not all(least) else sorted(sorted(a) for a in least)


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """block, trigram and docs: the posting lists of the trigrams in the rules' queries. Blocks are by hash of doc_id and as
    many as the postings ask for; only postings are shuffled."""
    grams = sorted({g for r in rules for alt in trigram_query(r.pattern) or [] for g in alt})
    low = F.lower("text")
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    found = docs.where("doc_id is not null and text is not null").select("doc_id", low.alias("low")).select("doc_id", F.explode(held).alias("trigram"))
    found = cut(found, "secrets-found")
    blocks = found.count() // BLOCK_POSTINGS + 1
    return found.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("doc_id").alias("docs"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the rules that its text may match: of some alternative of the query all posting lists hold it."""
    none = F.array().cast(index.schema["docs"].dataType)
    posting = lambda g: F.coalesce(F.try_element_at("lists", F.lit(g)), none)

    def met(rule: Rule) -> Column:
        name = F.lit(rule.name)
        alternatives = [reduce(F.array_intersect, map(posting, alt)) for alt in trigram_query(rule.pattern) or []]
        return F.transform(F.array_distinct(F.flatten(F.array(*alternatives))), lambda d: F.struct(d.alias("doc_id"), name.alias("rule")))

    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "docs"))).alias("lists"))
    found = lists.select(F.explode(F.flatten(F.array(*[met(r) for r in rules if trigram_query(r.pattern)]))).alias("c")).select("c.*")
    return found.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _spans(rule: Rule, text: Column) -> Column:
    """Array of (start, end, kind) of a rule's matches in text."""
    whole = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(rule.value_group + 1))
    gaps = F.split(text, rule.pattern, -1)
    sizes = F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("n")))
    sized = F.zip_with(sizes, value, lambda s, v: F.struct(s["gap"].alias("gap"), s["n"].alias("n"), F.char_length(v).alias("v")))
    kind = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("kind")))
    zero = F.struct(F.lit(0).alias("at"), F.slice(kind, 1, 0).alias("found"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        span = F.array(F.struct(start.alias("start"), (start + m["n"]).alias("end"), F.lit(rule.name).alias("kind")))
        return F.struct((start + m["n"]).alias("at"), F.when(m["v"] >= rule.least, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(sized, zero, step)["found"]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (start, end, kind; by start, then the rules' order) of each row."""
    with scratch(docs.sparkSession) as keep:
        index = cut(build_index(docs, rules), "secrets-postings")
        found = keep(cut(candidates(index, rules), "secrets-candidates"))
    small = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = found.withColumnRenamed("doc_id", "_doc")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(found) if small else found, F.col("doc_id") == F.col("_doc"), "left")
    none = F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("kind"))), 1, 0)
    parts = []
    for r in rules:
        may = (F.array_contains("rules", r.name) | F.col("doc_id").isNull()) if trigram_query(r.pattern) else F.lit(True)
        parts.append(F.when(F.coalesce(may, F.lit(False)) & F.rlike("text", F.lit(r.pattern)), _spans(r, F.col("text"))).otherwise(none))
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    spans = F.transform(F.flatten(F.array(*parts)), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.select("doc_id", F.transform(F.array_sort(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))
