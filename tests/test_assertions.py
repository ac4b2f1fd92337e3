"""Quantities and attributions in clauses: single cases, and word-by-word twins over made-up clauses."""

import random
import re

from pyspark.sql import functions as F

from claimspark.functions import quantities as Q
from claimspark.functions import text as T

NOUN = "jobs?|workers|units"


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame(list(enumerate(values)), "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def bound(c, least=1e6, money=True):
    return Q.bound_quantity(T.guard_norm(c), NOUN, least, money)


def test_what_bounds_a_quantity(spark):
    yes = [
        "AI will create 2 million jobs", "no fewer than 2 million jobs", "not less than 1 million workers", "about 2 million jobs", "jobs now number more than 3 million", "2 million of jobs", "workers have already reached 5,000,000", "It said: 1000000 units!",
        "5 jobs here but 3 million jobs there", "2 million jobs will be created", "not so; 2 million jobs exist",
    ]
    no = [
        "3 million jobs were not created", "2 million job hours lost", "3 million jobs will never exist", "2 million jobs is impossible", "2 million jobs are unattainable", "cannot create 2 million jobs", "no plan of any kind for 2 million jobs",
        "fails to add 2 million jobs", "nearly 2 million jobs", "just shy of 1.5 million workers", "2 million jobs or fewer", "2 million jobs at most", "about one million jobs", "roughly 1,000,000 units", "revenue of 2 million units", "2 million units sold",
        "jobs of at least 3 million hours", "units total 4 million transactions", "workers under 2 million", "in 2030 jobs", "jobs in 2030", "2 million", "jobs", "2 million equivalents of jobs",
    ]
    assert column(spark, yes, bound) == [True] * len(yes)
    assert dict(zip(no, column(spark, no, bound), strict=True)) == dict.fromkeys(no, False)
    years = lambda c: Q.bound_quantity(T.guard_norm(c), NOUN, 1000)
    assert column(spark, ["by 2030 jobs grew", "2030 jobs were lost", "fiscal year 2030 jobs", None], years) == [False, True, False, False]
    assert column(spark, ["usd 2 million units", "2 million units sold"], lambda c: bound(c, money=False)) == [True, True]


UNITS = {"million": 10**6, "billion": 10**9, "thousand": 10**3}
CONNECT = set("now already will have is are at least to over about more than reached number total of".split())
MEASURES = {"hours", "hour", "tokens", "days"}


def twin_bound(text, least):
    """Words one after the other: each number with its noun right behind, or before it with connecting words between."""
    for clause in re.split(r" [.;!?] ?| (?:but|while) ", text):
        ws = clause.split()
        for i, w in enumerate(ws):
            if not re.fullmatch(r"\d+(\.\d+)?", w):
                continue
            unit = ws[i + 1] if i + 1 < len(ws) and ws[i + 1] in UNITS else None
            value, j = float(w) * UNITS.get(unit, 1), i + 1 + (unit is not None)
            k = j + (j < len(ws) and ws[j] == "of")
            readings = []
            if k < len(ws) and ws[k] in ("jobs", "job", "workers", "units"):
                readings.append((ws[:i], ws[k + 1 :]))
            for b in range(i - 1, max(-1, i - 9), -1):
                if ws[b] in ("jobs", "job", "workers", "units"):
                    readings.append((ws[:b] + ws[b + 1 : i], ws[j:]))
                    break
                if ws[b] not in CONNECT:
                    break
            for before, after in readings:
                head, tail = " ".join(before), " ".join(["", *after])[:42].strip()
                near = tail.split()
                if any(x in ("not", "never", "no") for x in before) or re.search(r"(?:at most|nearly|under)$", head):
                    continue
                if near[:1] in (["not"], ["never"]) or near[1:2] in (["not"], ["never"]) and near[0] in ("will", "are", "is") or near[:2] == ["are", "impossible"]:
                    continue
                if near and near[0] in MEASURES or "at most" in tail or "under" in near or (value == least and before[-1:] == ["about"]):
                    continue
                if unit is None and re.fullmatch(r"20\d\d", w) and before[-1:] in (["by"], ["in"]):
                    continue
                if value >= least:
                    return True
    return False


def test_quantities_beside_twin(spark):
    random.seed(4)
    words = "jobs job workers units 2 3 900 2030 1.5 million million billion thousand of not never at_most nearly under about are will impossible hours tokens in by reached now more_than people . but".split()
    words += ["3_million_jobs", "2_million_of_units", "jobs_are_now_2_million", "workers_reached_3_billion", "2000_units", "units_total_900"] * 2
    texts = [" ".join(random.choice(words) for _ in range(random.randrange(1, 9))).replace("_", " ") for _ in range(1500)]
    for least in (1000.0, 2e6):
        got = column(spark, texts, lambda c, n=least: Q.bound_quantity(c, NOUN, n, False))
        want = [twin_bound(t, least) for t in texts]
        assert {t: g for t, g, w in zip(texts, got, want, strict=True) if g != w} == {} and sum(want) > 150


CASES = {
    "AI does 60% of all work": ["active", "near_total"], "AI helps humans do 60% of work": [], "Robots have automated 55% of tasks": ["active"], "AI does 40% of the work": [], "AI does at most 60% of work": [], "AI does nearly 60% of work": [],
    "AI cannot do 60% of work": [], "People used AI and it does 60% of work": [], "Agents account for 75% of jobs": ["active"],
    "70% of jobs are done by machines": ["passive"], "70% of jobs are not done by machines": [], "30% of jobs are done by machines": [], "At most 70% of jobs are done by machines": [], "70% of jobs are done by people": [],
    "robots share of work is 80%": ["share"], "AI's share of all jobs reached 51%": ["share"], "workers and robots share of work is 80%": [],
    "AI leaves exactly two jobs left": ["two_jobs_left", "near_total", "cognitive_majority"], "If AI wins there are two jobs left": [], "People have two jobs left": [],
    "almost all tasks are performed by agents": ["near_total"], "AI performs nearly all work": ["near_total"], "AI did make work optional": ["near_total"], "people do everything": [], "Humans perform all work": [],
    "Robots perform almost all cognitive and physical tasks": ["near_total_tasks"], "Robots will do everything": ["near_total_tasks"], "AI will do everything": [],
    "Robots do everything except physical work": ["physical_limit"], "AI cannot perform physical work": ["physical_limit"], "Physical labor remains human": ["physical_limit"], "Manual tasks are not performed by AI": ["physical_limit"],
    "AI performs more than half of cognitive work": ["cognitive_majority"], "AI does 60% of cognitive work": ["active", "cognitive_majority"], "AI does 50% of cognitive work": ["active"], "Most cognitive work is done by AI": ["cognitive_majority"],
    "AI produces more cognitive work than humans": ["cognitive_majority"], "AI cognitive labor exceeds humans": ["cognitive_majority"],
    "AI agents earned $10 billion": ["revenue"], "AI agents generate 10 billion dollars": ["revenue"], "AI agents never earned $10 billion": [], "A platform hosting AI agents earned $10 billion": [], "AI agents and a company earned $10 billion": [],
    "None of the revenue comes from AI agents": ["no_revenue"], "Revenue did not come from AI agents": ["no_revenue"], "The revenue was not generated by AI agents": ["no_revenue"], "No income is earned by agents": ["no_revenue"],
    "GPU capacity hits 3 terawatts": ["compute_scale"], "data centers hold 2 billion H100 equivalents": ["compute_scale"], "a game engine's compute is 3 terawatts": [], "GPU use is under 3 terawatts": [], "wind reaches 3 terawatts": [],
}


def test_each_rule(spark):
    got = column(spark, list(CASES), lambda c: Q.attribution_tags(T.guard_norm(c)))
    assert {c: g for c, g in zip(CASES, got, strict=True) if g != CASES[c]} == {}
    assert {x for v in CASES.values() for x in v} == {*Q.RULES, "compute_scale"}
    assert column(spark, [None, ""], lambda c: Q.attribution_tags(T.guard_norm(c))) == [[], []]


KIND = {w: k for k, ws in Q.KINDS.items() for w in ws}


def twin_tags(clause, least=50):
    """active, passive, share, near_total and two_jobs_left, read with loops over words."""
    ws = clause.replace("two jobs left", "twojobsleft").split()
    ks = ["9" if w.isdigit() and int(w) > least else "5" if w.isdigit() and int(w) == least else "0" if w.isdigit() else KIND.get(w, "z") for w in ws]
    n, tags = len(ks), set()

    def actor(i):
        return ks[i] in "ARa" and "H" not in ks[:i] and not {"N", "n"} & set(ks[max(0, i - 2) : i])

    def scope(i):
        """Where work ends after `of all the`, other words and what kind of it."""
        i += i < n and ks[i] == "O"
        ends, steps = set(), 0
        starts = [i]
        while steps < 2 and starts[-1] < n and ks[starts[-1]] in "TE":
            starts.append(starts[-1] + 1)
            steps += 1
        for s in starts:
            for more in range(3):
                if all(k in "zCF" for k in ks[s : s + more]) and s + more < n and ks[s + more] == "W":
                    ends.add(s + more + 1)
        return ends

    def acts_until(j, gap=None):
        """An actor, its action, and nothing that cancels up to place j."""
        for v in range(j):
            if ks[v] in "VP" and not set("NnVP") & set(ks[v + 1 : j]):
                for a in range(v - 1, -1, -1):
                    if set(ks[a + 1 : v]) & set("HNnARa"):
                        break
                    if actor(a):
                        return True
        return False

    def passive(i):
        if i < n and ks[i] == "B":
            for more in (0, 1):
                if more and (i + 1 >= n or ks[i + 1] != "z"):
                    continue
                j = i + 1 + more
                if j + 1 < n and ks[j] in "PD" and ks[j + 1] == "Y":
                    j += 2
                    j += j < n and ks[j] == "T"
                    for k in (j, j + 1):
                        if k < n and ks[k] in "ARa" and (k == j or ks[j] == "z"):
                            return True
        return False

    for p in range(1, n):
        if ks[p] == "%" and ks[p - 1] in "59":
            clear = p < 2 or ks[p - 2] not in "LNn"
            if clear and scope(p + 1) and acts_until(p - 1) and (p < 2 or ks[p - 2] not in "LNnVP" or ks[p - 2] in "VP"):
                tags.add("active")
            if clear and any(passive(e) for e in scope(p + 1)):
                tags.add("passive")
            for a in range(p - 1):
                for s in range(a + 1, p - 1):
                    if actor(a) and ks[s] == "S" and not set(ks[a + 1 : s]) & set("HNnARa"):
                        if any(ks[w] == "W" and not set(ks[s + 1 : w] + ks[w + 1 : p - 1]) & set("NnS") for w in range(s + 1, p - 1)):
                            tags.add("share")
    for e in range(n):
        if ks[e] == "E":
            j = e - (e > 0 and ks[e - 1] == "L")
            after = [e + 1 + m for m in range(3) if all(k == "z" for k in ks[e + 1 : e + 1 + m])]
            if any(w < n and ks[w] == "W" for w in after) and (acts_until(j) or acts_until(e)):
                tags.add("near_total")
            for m in range(3):
                w = e + 1 + m
                if w < n and ks[w] == "W" and all(k in "zCF" for k in ks[e + 1 : w]) and passive(w + 1):
                    tags.add("near_total")
    if "J" in ks and "I" not in ks[: ks.index("J")]:
        j = ks.index("J")
        if any(ks[a] in "ARa" and not {"N", "n"} & set(ks[max(0, a - 2) : a]) and not set(ks[a + 1 : j]) & set("NnARa") for a in range(j)):
            tags |= {"two_jobs_left", "near_total"}
    return tags


def test_attributions_beside_twin(spark):
    random.seed(11)
    words = "ai robots workers does performed do done 60 50 20 percent percent of all the work tasks is are by not nearly share new cognitive physical people if two_jobs_left automates almost".split()
    words += ["ai_does", "robots_automates", "60_percent_of_the_work", "50_percent_of_tasks", "is_done_by_ai", "are_performed_by_robots", "nearly_all_tasks", "ai_share_of_work_is", "ai"] * 2
    texts = [" ".join(random.choice(words) for _ in range(random.randrange(3, 12))).replace("_", " ") for _ in range(6000)]
    names = {"active", "passive", "share", "near_total", "two_jobs_left"}
    got = column(spark, texts, Q.attribution_tags)
    want = [twin_tags(t) for t in texts]
    assert {t: (g, w) for t, g, w in zip(texts, got, want, strict=True) if set(g) & names != w} == {}
    assert all(sum(n in w for w in want) >= 5 for n in names - {"passive"})


def test_no_rule_holds_without_what_is_asked_for():
    """Words of all kinds but those that _CALLS finds: no pattern of letters holds."""
    random.seed(10)
    letters = "".join(k for k in Q.KINDS if k not in "ARaF") + "z059"
    for _ in range(3000):
        ls = "".join(random.choices(letters, k=random.randrange(1, 12)))
        assert not [n for n, (*_, p) in Q.RULES.items() if re.search(p, ls)]
    asked = [w for k in "ARaF" for w in Q.KINDS[k]] + ["virtual worker", "virtual workers", "real world", "copies of ai agent", "agent copies", "ai agents"]
    assert all(re.search(Q._CALLS, f"x {w} y") for w in asked)


def test_whole_texts_have_the_tags_of_their_guard_text(spark):
    """Only pieces with a word that a rule asks for are normalised; what joins or parts words in raw text changes nothing."""
    random.seed(12)
    parts = "AI|ai's|softwaren't|Robots|réAI|x_AI_|does|perform|60%|50 percent|of all work|the work|tasks|is done by|are performed by|nobody|People|real-world|Virtual\n workers|two jobs left|physical labor|remains|everything except|compute|data-centers|3 terawatts of|5,000,000,000 H100s|not|but|e.g.|. |! |?!|.\n|; |.x|...| . |,|\t|revenue from|agents earn $5|2.5|won't".split("|")
    texts = ["".join(random.choice(parts) + random.choice((" ", " ", " ", "")) for _ in range(random.randrange(1, 24))) for _ in range(5000)]
    got, want = column(spark, [*texts, None, ""], Q.text_attribution_tags), column(spark, [*texts, None, ""], lambda c: Q.attribution_tags(T.guard_norm(c)))
    assert {t: (g, w) for t, g, w in zip(texts, got, want, strict=False) if g != w} == {} and got[-2:] == [[], []]
    assert len({x for w in want for x in w}) >= 8
