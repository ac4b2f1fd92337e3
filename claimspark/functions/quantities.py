"""What a claim's clause asserts of a quantity or of who does the work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

_NUMBER = r"([0-9]+(?:\.[0-9]+)?|one|two|three|four|five|six|seven|eight|nine|ten|dozen|hundred) ?(millions?|billions?|trillions?|thousands?|bn|[mbtk])?"
#: Where a number begins.
_BEGINS = r"(?<![a-z0-9.])(?=[0-9]|(?:one|two|three|four|five|six|seven|eight|nine|ten|dozen|hundred)\b)"
#: Characters after a quantity, and before one for money, that bear on it.
REACH = 42
# fixed values: words of bounds, negation, measures, money and verbs that connect a noun with its number
LEAST = r"\b(?:no|not) (?:less|fewer) than\b"
UPPER_BEFORE = r"\b(?:below|under|just under|less than|fewer than|at most|up to|no more than|not more than|maximum of|nearly|almost|just shy of|shy of|short of|approach(?:es|ed|ing)?|nearing|close to|not yet at)(?: roughly| approximately| about)?$"
UPPER_AFTER = r"\b(?:below|under|less than|fewer than|at most|or less|or fewer|maximum|upper bound|no more than)\b"
VAGUE = r"\b(?:about|around|approximately|roughly|circa)$"
NEGATION = r"\b(?:no|not|never|cannot|without|fail(?:s|ed)?|unable to|incapable of|lack(?:s|ed)?|insufficient)\b"
NEGATED_AFTER = r"^ ?(?:(?:will|would|could|can|may|might|does|do|is|are|was|were) )?(?:not|never)\b|^ ?(?:is|are|was|were|remains?|seems?) (?:impossible|unattainable|unreachable|infeasible)\b"
MEASURE_AFTER = r"^ ?(?:(?:completed|successful|failed|automated|processed|recorded|executed|finished|cumulative|daily|monthly|annual|total) ){0,3}(?:hours?|days?|weeks?|months?|years?|minutes?|seconds?|tokens?|operations?|cycles?|tasks?|task completions?|completions?|requests?|calls?|transactions?|runs?|episodes?|steps?|events?|equivalents?(?! to\b))\b"
YEAR_BEFORE = r"\b(?:(?:by|in|during|since|until|before|after|around|from|through)(?: the)?(?: calendar| fiscal)?(?: year)?|(?:calendar|fiscal) year|cy|fy)$"
MONEY = r"\b(?:currency|nonusd|usd|eur|gbp|jpy|cny|rmb|aud|cad|nzd|hkd|sgd|krw|chf|inr|dollars?|euros?|pounds?|yen|yuan|won|revenue|valuation|valued|worth|market|priced?|costs?|sold|selling|sale)\b"
CONNECTOR = "(?:now|currently|already|will|would|could|can|may|might|projected|expected|has|have|had|is|are|was|were|of|at|least|to|over|above|about|more|than|with|reach(?:es|ed)?|number(?:s|ed)?|total(?:s|ed)?|scale(?:s|d)?|grow(?:s|n)?|grew|stand(?:s)?|stood|hit(?:s)?|exceed(?:s|ed)?|surpass(?:es|ed)?|start(?:s|ed)?|some)"


def bound_quantity(guard: Column, noun: str, minimum: float, reject_money: bool = True) -> Column:
    """Whether a clause of a guard_norm() text asserts at least `minimum` of a noun (a pattern); false for a null text.

    Every quantity of a clause is tried. It may stand right before its noun, or after it and up to seven words that connect
    them. It is judged by both sides of it: upper bounds right before or soon after, a negation anywhere before or right
    after, what is said to be impossible, a unit that it really counts (job hours), `about` just at the minimum, a year
    after its preposition, and sums of money unless they are wanted."""
    forward = rf"^{_NUMBER}(?: of)? (?:{noun})\b(.*)$"
    subject, backward = rf"^(.*?)\b(?:{noun})((?: {CONNECTOR}){{0,7}}) $", rf"^{_NUMBER}\b(.*)$"

    def holds(before: Column, bridge: Column, number: Column, pattern: str) -> Column:
        token, unit, rest = (F.regexp_extract(number, pattern, i) for i in (1, 2, 3))
        value = T.quantity(token, unit)
        head = F.trim(F.regexp_replace(F.concat(before, bridge), LEAST, "at least"))
        after = F.regexp_replace(F.substring(rest, 1, REACH), LEAST, "at least")
        year = (unit == "") & token.rlike("^(?:19[0-9]{2}|20[0-9]{2}|2100)$") & head.rlike(YEAR_BEFORE)
        barred = year | head.rlike(UPPER_BEFORE) | after.rlike(UPPER_AFTER) | head.rlike(NEGATION) | after.rlike(NEGATED_AFTER) | after.rlike(MEASURE_AFTER) | bridge.rlike(r"\bequivalent\b")
        if reject_money:
            near = F.when(F.length(head) > REACH, F.substring(head, -REACH, REACH)).otherwise(head)
            barred = barred | near.rlike(MONEY) | F.substring(rest, 1, 24).rlike(MONEY)
        return F.coalesce((value >= minimum) & ~barred & ~(head.rlike(VAGUE) & (value == minimum)), F.lit(False))

    def asserted(clause: Column) -> Column:
        parts = F.split(F.regexp_replace(clause, _BEGINS, "\u0001"), "\u0001")

        def one(i: Column) -> Column:
            before, number = F.array_join(F.slice(parts, F.lit(1), i), ""), F.array_join(F.slice(parts, i + 1, F.size(parts)), "")
            return holds(before, F.lit(""), number, forward) | (before.rlike(subject) & holds(F.regexp_extract(before, subject, 1), F.regexp_extract(before, subject, 2), number, backward))

        return F.when(F.size(parts) > 1, F.exists(F.sequence(F.lit(1), F.size(parts) - 1), one)).otherwise(False)

    return F.coalesce(F.exists(T.clauses(guard), asserted), F.lit(False))


# --- who does the work ------------------------------------------------------------------------------------------------

#: Phrases that become one word before a clause is read.
PHRASES = [
    (r"\b(?:no|not) (?:less|fewer) than\b", "atleast"), (r"\b(?:at most|less than|fewer than|or less|or fewer|up to|no more than)\b", "atmost"), (r"\baccount(?:s|ed)? for\b|\bmakes? up\b", "comprise"),
    (r"\b(?:more than half|a majority|the majority)\b", "majority"), (r"\breal world\b", "physical"), (r"\b(?:exactly )?two jobs left\b", "twojobsleft"), (r"\bwork (?:will be |becomes? )?optional\b", "workoptional"),
    (r"\b(?:copies of ai agents?|ai agents?|agent copies|virtual workers?)\b", "agentcopies"), (r"\b(?:apart from|other than|but not)\b", "except"), (r"\bbrings? in\b", "earns"), (r"\bai users?\b", "users"),
]
#: A letter for each kind of word; all others are z, numbers 0, 5 and 9 for below, at and above the least percent.
KINDS = {
    "A": ["ai", "model", "models", "agent", "agents", "automation", "machine", "machines", "software"],
    "R": ["robot", "robots"],
    "a": ["agentcopies"],
    "H": ["human", "humans", "people", "worker", "workers", "employee", "employees", "consultant", "consultants", "contractor", "contractors", "staff", "user", "users", "operator", "operators", "professional", "professionals", "developer", "developers", "analyst", "analysts", "doctor", "doctors", "lawyer", "lawyers", "teacher", "teachers"],
    "V": ["perform", "performs", "produce", "produces", "provide", "provides", "contribute", "contributes", "contributed", "do", "does", "did", "complete", "completes", "automate", "automates", "handle", "handles", "comprise"],
    "P": ["performed", "produced", "provided", "completed", "automated", "handled"],
    "D": ["done"],
    "w": ["generate", "generates", "generated", "generating", "earn", "earns", "earned", "earning"],
    "N": ["no", "not", "never", "cannot", "none", "zero", "nobody", "fail", "fails", "failed", "unable", "incapable", "lack", "lacks", "lacked", "without"],
    "n": ["atmost", "below", "under", "only"],
    "W": ["work", "job", "jobs", "task", "tasks", "labor", "labour"],
    "C": ["cognitive"],
    "F": ["physical", "manual"],
    "S": ["share", "portion", "fraction", "percentage"],
    "%": ["percent"],
    "B": ["is", "are", "was", "were"],
    "Y": ["by"],
    "O": ["of"],
    "T": ["the"],
    "E": ["all", "every"],
    "L": ["nearly", "almost", "virtually"],
    "M": ["majority", "most"],
    "G": ["more"],
    "t": ["than"],
    "g": ["exceed", "exceeds", "outnumber", "outnumbers"],
    "U": ["and", "or"],
    "X": ["everything"],
    "e": ["except", "excluding"],
    "r": ["remain", "remains", "remained", "beyond"],
    "I": ["if", "assuming", "suppose", "supposing", "hypothetically"],
    "J": ["twojobsleft"],
    "Q": ["workoptional"],
    "v": ["revenue", "income", "earnings"],
    "$": ["usd", "dollar", "dollars"],
    "k": ["platform", "company", "business", "firm", "service", "marketplace", "network", "customer", "customers", "client", "clients", "owner", "owners", "organization", "organisation"],
    "d": ["with", "for", "employs", "employing", "hosts", "hosting", "uses", "using", "manages", "serves", "supports", "runs", "running"],
}
#: An actor with no human before it and no negation in the two words before; then its action, with neither in between.
_ACTOR = r"^(?:[^H]*[^HNn]{2}|[^HNn]?)[ARa]"
_ACT = _ACTOR + r"[^HNnARa]*[VP]"
_ACTS = _ACT + r"[^NnVP]*"
#: Up to a number that nothing right before makes an upper bound.
_PLAIN = r"(?:[^NnVP]*[^LNnVP])?"
_PASSIVE = r"Bz?[PD]YT?z?[ARa]"
_SCOPE = r"O?[TE]{0,2}[zCF]{0,2}W"
_COMPUTE = r"\b(?:compute|gpus?|h100s?|data ?centers?)\b"
SIMULATED = r"\b(?:simulat[a-z]*|computer generated|render(?:s|ed|ing)?|game|gaming|metaverse|virtual (?:world|scene|factory)|synthetic (?:world|environment|dataset)|digital twin|(?:test|mock) environment)\b"
#: By the letters of a clause; all patterns of a list but the last forbid.
RULES: dict[str, list[str]] = {
    "active": [_ACT + rf"{_PLAIN}[59]%{_SCOPE}"],
    "passive": [rf"(?:^|[^LNn])[59]%{_SCOPE}{_PASSIVE}"],
    "share": [_ACTOR + r"[^HNnARa]*S[^NnS]*W[^NnS]*[59]%"],
    "two_jobs_left": [r"^[^J]*I", r"^(?:[^J]*[^NnJ]{2}|[^NnJ]?)[ARa][^NnARaJ]*J"],
    "near_total": [rf"(?:{_ACTS}(?:L?Ez{{0,2}}W|Q)|L?E[zCF]{{0,2}}W{_PASSIVE})"],
    "near_total_tasks": [rf"(?:{_ACTS}L?E(?:CUF|FUC)W|{_ACTOR.replace('[ARa]', 'R')}[^HNnARa]*[VP][^NnVP]*X)"],
    "cognitive_majority": [rf"(?:{_ACT}{_PLAIN}9%O?[TE]{{0,2}}CW|{_ACTS}(?:MO?E?CW|GCWtH)|9%O?[TE]{{0,2}}CW{_PASSIVE}|MO?E?CW{_PASSIVE}|^[^H]*[ARa]z?CWg(?:zO)?H)"],
    "physical_limit": [r"(?:X.{0,20}e.{0,10}F|[ARa].{0,30}N.{0,9}F[zW]|FW.{0,9}r|FW.{0,9}N.{0,4}[PD]YT?[ARa]|[ARa].{0,12}n.{0,8}FW)"],
    "revenue": [r"k[^a]*d[^a]*a[^a]*w", r"^[^a]*(?:a[^a]*)*a[^aHNnk]*[wVP][^NnwVP]*(?:\$[059]|[059]z?\$)"],
    "no_revenue": [r"(?:NO[Tz]?v.{1,4}[Aa]|v[BVz]N.{1,4}[Aa]|NvB[wP]YT?[Aa])"],
}


#: What a clause must hold for any of RULES: each pattern asks for an A, R or a, but for two of physical_limit that ask for
#: an F. The words of these kinds, and of the phrases that become one.
_CALLS = r"\b(?:ai|models?|agents?|automation|machines?|software|robots?|agentcopies|virtual workers?|physical|manual|real world)\b"


def labelled(clause: Column, least_percent: int) -> Column:
    """A letter for each word of a clause, by KINDS."""

    def letter(w: Column) -> Column:
        value = w.try_cast("double")
        out = F.lit("z")
        for kind, words in reversed(KINDS.items()):
            out = F.when(w.isin(words), kind).otherwise(out)
        number = F.when(value > least_percent, "9").when(value == least_percent, "5").when(value.isNotNull(), "0")
        return F.coalesce(F.when(w.rlike("^(?:[0-9.]|nan$|inf$|infinity$)"), number), out)  # a word that is no number is slow to cast

    for pattern, word in PHRASES:
        clause = F.regexp_replace(clause, pattern, word)
    return F.array_join(F.transform(F.split(clause, " "), letter), "")


def attribution_tags(guard: Column, least_percent: int = 50, terawatts: float = 2, accelerators: float = 1e9) -> Column:
    """What the clauses of a guard_norm() text assert of machines that do work, in this order:

    active (AI does 60 percent of the work), passive (60 percent is done by AI), share (AI's share is 60 percent): at least
    `least_percent`; two_jobs_left; near_total and near_total_tasks (all work, or two jobs left; all cognitive and physical
    tasks, or everything that robots do, unless a physical_limit is stated); cognitive_majority (most, more than half, more
    than humans, or two jobs left); physical_limit; revenue and no_revenue (agents earn a sum, or none comes from them); compute_scale (so many
    terawatts or accelerators, not simulated). People as the ones who act, a negation or an upper bound between actor and
    work cancel.

    Each clause that holds what some rule asks for is read once, word by word, into letters for what its words do, and
    rules are patterns of these letters."""

    def found(ls: Column, clauses: Column) -> Column:
        def holds(name: str) -> Column:
            *never, pattern = RULES[name]
            return F.exists(ls, _all_of(pattern, never))

        limit, two = holds("physical_limit"), holds("two_jobs_left")
        compute = F.exists(clauses, lambda c: c.rlike(_COMPUTE) & ~c.rlike(SIMULATED) & (bound_quantity(c, "terawatts?|tw", terawatts, False) | bound_quantity(c, "h100 equivalents?|gpu equivalents?|h100s?", accelerators)))
        more = {"near_total": holds("near_total") | two, "cognitive_majority": holds("cognitive_majority") | two, "near_total_tasks": holds("near_total_tasks") & ~limit, "physical_limit": limit, "two_jobs_left": two}
        hits = [F.when(more[n] if n in more else holds(n), n) for n in RULES]
        return F.array_compact(F.array(*hits, F.when(compute, "compute_scale")))

    def read(clauses: Column) -> Column:
        letters = F.transform(F.filter(clauses, lambda c: c.rlike(_CALLS)), lambda c: labelled(c, least_percent))
        return T.once(letters, lambda ls: found(ls, clauses))

    none = F.array().cast("array<string>")
    return T.once(guard, lambda g: F.when(g.rlike(f"{_CALLS}|{_COMPUTE}"), T.once(T.clauses(g), read)).otherwise(none))


#: _CALLS and _COMPUTE for lower-case raw text, where signs that become spaces may stand around and within.
_RAW = r"(?<![a-z0-9])(?:ai|models?|agents?|automation|machines?|software|robots?|agentcopies|virtual[^a-z0-9]+workers?|physical|manual|real[^a-z0-9]+world|compute|gpus?|h100s?|data[^a-z0-9]*centers?)(?:(?![a-z0-9])|(?=n't))"


def text_attribution_tags(text: Column) -> Column:
    """attribution_tags() of guard_norm(text), with the same result. No step of guard_norm() reaches over a sentence sign and
    the white space behind it, where clauses end too, so texts are cut there and only pieces that hold a word which some
    rule asks for are normalised."""
    pieces = F.split(text, r"(?<=[.;!?])\s+")
    asked = F.filter(pieces, lambda p: F.lower(p).rlike(_RAW))
    return T.once(asked, lambda ps: F.when(F.size(ps) > 0, attribution_tags(F.array_join(F.transform(ps, lambda p: T.guard_norm(p)), " . "))).otherwise(F.array().cast("array<string>")))


def _all_of(pattern: str, never: list[str]) -> Callable[[Column], Column]:
    def test(c: Column) -> Column:
        out = c.rlike(pattern)
        for p in never:
            out = out & ~c.rlike(p)
        return out

    return test
