import random

from pyspark.sql import functions as F

from clausewright.functions import fixed
from clausewright.operators import checks, corrections, lookups, quotes, responses, scale, shortlist, verdicts

CLAIM = ("claim_id long, policy_id long, scenario string, procedure string, condition string, held_days long, "
         "pre_existing_condition string, age int, age_at_policy_start int, inception_age long, sum_insured_rupees long, "
         "room_rent_per_day_inr long, room_is_icu boolean, expense_timing_anchor string, expense_days long")
CLAUSE = ("policy_id long, clause_id string, order_idx int, section_path string, heading string, text string, "
          "clause_type string, impact double, waiting_periods_days array<int>, exceptions array<string>, copay_percent int, "
          "copay_min_age_at_inception int, cap_percent_of_sum_insured int, icu_cap_percent_of_sum_insured int, "
          "cap_max_inr_per_day int, icu_cap_max_inr_per_day int, cover_window_days int, cover_window_anchor string")


def claim(i, **facts):
    names = [c.split()[0] for c in CLAIM.split(", ")]
    base = dict(claim_id=i, policy_id=1, scenario="", pre_existing_condition="unknown")
    return tuple({**base, **facts}.get(n) for n in names)


def clause(cid, idx=0, **terms):
    names = [c.split()[0] for c in CLAUSE.split(", ")]
    base = dict(policy_id=1, clause_id=cid, order_idx=idx, section_path="", heading="", text="", clause_type="coverage",
                impact=0.0, waiting_periods_days=[], exceptions=[])
    return tuple({**base, **terms}.get(n) for n in names)


def frames(spark, claims, clauses):
    return spark.createDataFrame(claims, CLAIM), spark.createDataFrame(clauses, CLAUSE)


def test_waiting_boundaries(spark):
    text = "A wait applies to some ailments."
    a, b = frames(
        spark,
        [claim(1, held_days=730), claim(2, held_days=729), claim(3), claim(4, held_days=800), claim(5, held_days=1080)],
        [clause("w1", heading="2.1 Wait", text=text, waiting_periods_days=[730]),
         clause("w2", heading="2.2 Specified waits", text=text, waiting_periods_days=[730, 1080]),
         clause("d", text="A wait means this. Term means that.", waiting_periods_days=[30]),
         clause("n", text="Nothing said of time.", waiting_periods_days=[30]),
         clause("r", heading="Named waiting period", text="Twenty four (24) months, or 36-month.", clause_type="exclusion")])
    got = {(r.claim_id, r.clause_id): r.status for r in checks.waiting_checks(a, b).collect()}
    assert got[(1, "w1")] == "served" and got[(2, "w1")] == "not_served" and got[(3, "w1")] == "unknown"
    assert got[(4, "w2")] == "partly_served" and got[(5, "w2")] == "served" and got[(4, "r")] == "partly_served"
    assert not [k for k in got if k[1] in ("d", "n")]
    row = checks.waiting_clauses(b).filter("clause_id = 'w2'").collect()[0]
    assert row.listed and row.subject == "Specified waits"


def test_window_boundaries(spark):
    a, b = frames(
        spark,
        [claim(1, expense_timing_anchor="after_discharge", expense_days=90),
         claim(2, expense_timing_anchor="after_discharge", expense_days=91),
         claim(3, expense_timing_anchor="before_admission", expense_days=1),
         claim(4, expense_timing_anchor="after_discharge"), claim(5)],
        [clause("a", text="Costs up to 90 days, as stated, post the date of discharge are met.")])
    got = {r.claim_id: r.status for r in checks.window_checks(a, b).collect()}
    assert got == {1: "within", 2: "outside", 3: "not_raised", 4: "unknown", 5: "not_raised"}


def test_reductions(spark):
    a, b = frames(
        spark,
        [claim(1, age=68, inception_age=61, sum_insured_rupees=300000, room_rent_per_day_inr=6000),
         claim(2, age=68, procedure="oral chemotherapy treatment"), claim(3, inception_age=60, age=60),
         claim(4, sum_insured_rupees=300000, room_rent_per_day_inr=5000),
         claim(5, room_rent_per_day_inr=5001, sum_insured_rupees=300000, room_is_icu=True)],
        [clause("c", 1, copay_percent=20, copay_min_age_at_inception=61, clause_type="sub_limit"),
         clause("r", 2, cap_percent_of_sum_insured=2, cap_max_inr_per_day=5000, clause_type="sub_limit"),
         clause("j", 3, text="Oral chemotherapy is limited.", clause_type="sub_limit")])
    got = {(r.claim_id, r.clause_id): r for r in checks.reduction_checks(a, b).collect()}
    assert [got[(i, "c")].status for i in (1, 2, 3, 4)] == ["applies", "unknown", "does_not_apply", "not_raised"]
    assert got[(1, "r")].status == "applies" and got[(1, "r")].limit_inr == 5000
    assert got[(4, "r")].status == "does_not_apply" and got[(2, "r")].status == "not_raised"
    # No intensive care cap: the clause is left to judgement.
    assert got[(5, "r")].kind == "other_cap" and got[(2, "j")].named == ["chemotherapy", "oral"]


def brute_fit(items, keep, budget):
    order = sorted(range(len(items)), key=lambda i: (
        items[i][0] not in keep, items[i][1] in fixed.DROPPED_FIRST, -items[i][2], i))
    kept, used = set(), 0
    for i in order:
        if used + items[i][3] > budget and kept:
            continue
        kept.add(i)
        used += items[i][3]
    return sorted(kept)


def test_shortlist_skips_and_continues(spark):
    rng = random.Random(5)
    claims, clauses, want = [], [], {}
    for p in range(40):
        items = []
        for i in range(rng.randint(1, 14)):
            text = "x" * rng.randint(0, 900)
            kind, impact = rng.choice(fixed.CLAUSE_TYPES), float(rng.randint(0, 5))
            items.append((f"c{i}", kind, impact, int(len(text) / 3.5) + 20))
            clauses.append(clause(f"c{i}", i, policy_id=p, text=text, clause_type=kind, impact=impact))
        claims.append(claim(p, policy_id=p))
        want[p] = brute_fit(items, {"c1", "c3"}, 400)
    a, b = frames(spark, claims, clauses)
    named = a.select("claim_id", F.explode(F.array(F.lit("c1"), F.lit("c3"))).alias("clause_id"))
    got = {r.claim_id: r.kept for r in shortlist.shortlist(a, b, named, 400).collect()}
    assert got == want
    groups = {}
    for r in shortlist.pack_groups(b, 400).orderBy("policy_id", "order_idx").collect():
        groups.setdefault(r.policy_id, []).append(r.group_no)
    for p in groups:
        costs = [int(len(c[5]) / 3.5) + 20 for c in clauses if c[0] == p]
        n, used, expect = 0, 0, []
        for cost in costs:
            if used and used + cost > 400:
                n, used = n + 1, 0
            used += cost
            expect.append(n)
        assert groups[p] == expect


def test_question_lookups(spark):
    a, b = frames(
        spark,
        [claim(1, scenario="Ayurvedic care at an unaccredited clinic", procedure="caesarean section"),
         claim(2, scenario="I have no other policy. I hold a second policy at work."),
         claim(3, scenario="A thief hurt me while stealing my bag."), claim(4, scenario="Hurt while shoplifting in town.")],
        [clause("y", 1, text="Ayurveda at an accredited clinic is paid. See Annexure II.", section_path="ANNEXURE I"),
         clause("m", 2, text="Caesarean births are not paid.", clause_type="exclusion", exceptions=["ectopic pregnancy"]),
         clause("o", 3, text="Where other insurance exists a rateable share is paid."),
         clause("b", 4, text="Treatment due to breach of law with criminal intent.", clause_type="exclusion")])
    shared = {(r.claim_id, r.clause_id): r.words for r in lookups.shared_words(a, b).collect()}
    assert shared[(1, "m")] == ["caesarean"] and "ayurvedic" in shared[(1, "y")]
    rules = {(r.claim_id, r.rule, r.clause_id) for r in lookups.trigger_pairs(a, b).collect()}
    assert rules == {(2, "another_policy", "o"), (4, "breach_of_law", "b")}
    assert [(r.clause_id, r.label) for r in lookups.dangling_annexures(b, "policy_id").collect()] == [("y", "II")]
    assert [r.clause_id for r in lookups.naming_exclusions(a, b).collect()] == ["m"]


TEXT = ("The Company shall pay for in-patient care of the Insured. Room rent is capped at one percent.\n"
        "A pre-\nexisting ailment waits for three years from inception of the policy.")
QUOTES = {
    "exact": ("The Company shall pay for in-patient care", True, ""),
    "wrapped": ("a pre-existing ailment   waits for\nthree years", True, ""),
    "tagged": ("Room rent is capped at one percent. [3.2 (3.2)]", True, ""),
    "elided": ("The Company shall pay for in-patient care\nthree years from inception of the policy", True, ""),
    "reordered": ("three years from inception of the policy\nThe Company shall pay for in-patient care", False, "not found"),
    "trimmed": ("Room rent is capped at one percent. BY US", True, ""),
    "invented": ("The Company shall pay twice for every stay there is", False, "not found"),
    "short": ("The Company", False, "too short"), "empty": ("  \n ", False, "empty"),
}


def test_quote_audit(spark):
    rows = [(i, 1, 1, "c", q) for i, (q, _, _) in enumerate(QUOTES.values())] + [(99, 1, 1, "zz", "x" * 40)]
    cites = spark.createDataFrame(rows, "answer_id long, pos int, policy_id long, clause_id string, quote string")
    src = spark.createDataFrame([(1, "c", "coverage", TEXT)], "policy_id long, clause_id string, clause_type string, text string")
    got = {r.answer_id: r for r in quotes.audit_quotes(cites, src).collect()}
    for i, (name, (_, ok, why)) in enumerate(QUOTES.items()):
        assert (got[i].verified, got[i].reason) == (ok, why), name
    assert got[99].reason == "unknown clause"
    assert got[5].trimmed and got[5].quote.startswith("Room rent is capped")


def test_passages_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{'abcdefghij'[rng.randint(0, 9)] * rng.randint(1, 14)}{i}" for i in range(60)]
    docs = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(120)]
    passages = []
    for _ in range(150):
        d = rng.choice(docs)
        a = rng.randint(0, max(len(d) - 30, 0))
        passages.append(d[a:a + rng.randint(25, 120)])
    passages += [" ".join(rng.choice(words) for _ in range(5)), "too short", "z" * 30]
    p = spark.createDataFrame(list(enumerate(passages)), "passage_id long, text string")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r.passage_id, r.doc_id) for r in quotes.find_passages(p, d).collect()}
    norm = lambda s: " ".join(s.split()).lower()
    want = {(i, j) for i, x in enumerate(passages) if len(norm(x)) >= 25 for j, y in enumerate(docs) if norm(x) in norm(y)}
    assert got == want and len(want) > 100


def test_salted_join_equals_plain_join_on_a_hot_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    left = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 0 else id % 50 end as k")
    right = spark.range(40).selectExpr("id as k", "id * 2 as v")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plan = scale.salted_join(left, right, ["k"], how, spread="id", salts=7)
        assert sorted(map(tuple, plan.collect()), key=str) == sorted(map(tuple, left.join(right, ["k"], how).select(plan.columns).collect()), key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_exceptions_need_an_exception_word(spark):
    text = "No payment for eye glasses (unless after a fall) and hearing aids. Rs. 10 unless by a burn."
    df = spark.createDataFrame([(1, text, "exclusion", ["hearing aids", "after a fall", "by a burn", "absent"])],
                               "id long, text string, clause_type string, exceptions array<string>")
    assert corrections.verify_exceptions(df).collect()[0].exceptions == ["after a fall", "by a burn"]
    df = spark.createDataFrame([(1, "Costs of birth: a. all births except ectopic pregnancy b. other", "exclusion", [])],
                               "id long, text string, clause_type string, exceptions array<string>")
    assert corrections.add_trailing_exceptions(df).collect()[0].exceptions == ["ectopic pregnancy"]


EMPTY = dict(waits=[], cuts=[], windows=[], excluding=[], triggers=[], absent=[], cites=[], said=[])
ROW = ("answer_id long, claim_id long, policy_id long, verdict string, said array<string>, "
       "waits array<struct<clause_id:string,status:string,listed:boolean,pre_existing:boolean,exception_stems:array<string>>>, "
       "cuts array<struct<clause_id:string,status:string,named:int>>, windows array<struct<clause_id:string,status:string>>, "
       "excluding array<struct<clause_id:string>>, triggers array<struct<rule:string,clause_id:string>>, "
       "cites array<struct<pos:int,clause_id:string,effect:string,clause_type:string,verified:boolean>>, absent array<string>")


def wait(c, status, listed=False, pre=False, stems=()):
    return (c, status, listed, pre, list(stems))


def cite(c, effect, kind="coverage"):
    return (1, c, effect, kind, True)


RULES = [
    ("R1", "not_covered", dict(waits=[wait("w", "served")], cites=[cite("w", "denies")]), {("R1", "w")}),
    ("R1 permits", "not_covered", dict(waits=[wait("w", "served")], cites=[cite("w", "permits")]), set()),
    ("R2", "covered", dict(cuts=[("c", "applies", 0)], cites=[cite("c", "reduces")]), {("R2", "c")}),
    ("R3", "covered", dict(cuts=[("c", "applies", 0)]), {("R3", "c")}),
    ("R4", "covered", dict(waits=[wait("w", "not_served")]), {("R4", "w")}),
    ("R4 excepted", "covered", dict(waits=[wait("w", "not_served", stems=["accide"])], said=["accide"]), set()),
    ("R5", "not_covered", dict(waits=[wait("w", "not_served")]), {("R5", "w")}),
    ("R5 listed", "not_covered", dict(waits=[wait("w", "not_served", listed=True)]), set()),
    ("R6", "covered", dict(excluding=[("x",)], cites=[cite("x", "permits")]), {("R6", "x")}),
    ("R7", "conditional", dict(cites=[cite("a", "denies"), cite("b", "reduces")]), {("R7", "")}),
    ("R8", "insufficient_information", dict(windows=[("v", "outside")]), {("R8", "v")}),
    ("R8 one within", "covered", dict(windows=[("v", "outside"), ("u", "within")]), set()),
    ("R9", "covered", dict(absent=["l"], cites=[cite("l", "delays")]), {("R9", "l")}),
    ("R9 named", "covered", dict(absent=["l"], cites=[cite("l", "delays")], cuts=[("j", "judgement", 1)]), set()),
    ("R10", "covered", dict(triggers=[("another_policy", "o")]), {("R10", "o")}),
    ("R11", "conditional", dict(triggers=[("intoxication", "i")], cites=[cite("i", "permits")]), {("R11", "i")}),
    ("R12", "covered", dict(triggers=[("breach_of_law", "b")]), {("R12", "b")}),
    ("R13", "conditional", dict(waits=[wait("w", "unknown")], cites=[cite("w", "delays")]), {("R13", "w")}),
    ("R13 pre", "conditional", dict(waits=[wait("w", "unknown", pre=True)], cites=[cite("w", "delays")]), set()),
]


def rows_of(spark, cases):
    names = [c.split()[0] for c in ROW.split(", ")]
    data = [tuple({**EMPTY, **parts, "answer_id": i, "claim_id": i, "policy_id": 1, "verdict": v}[n] for n in names)
            for i, (v, parts) in enumerate(cases)]
    return spark.createDataFrame(data, ROW)


def test_each_rule_and_a_near_miss(spark):
    rows = rows_of(spark, [(v, p) for _, v, p, _ in RULES])
    got = {}
    for r in verdicts.contradictions(rows).collect():
        got.setdefault(r.answer_id, set()).add((r.rule, r.clause_id))
    for i, (name, _, _, want) in enumerate(RULES):
        assert got.get(i, set()) == want, name


def test_verdict_corrections(spark):
    cases = [
        ("covered", dict()),
        ("covered", dict(cuts=[("c", "does_not_apply", 0)], cites=[cite("c", "reduces")])),
        ("not_covered", dict(waits=[wait("w", "served")], cites=[cite("w", "denies")])),
        ("covered", dict(cuts=[("c", "applies", 0)], cites=[cite("x", "permits")])),
        ("conditional", dict(absent=["l"], cites=[cite("l", "permits")])),
        ("conditional", dict(cuts=[("c", "not_raised", 0)], cites=[cite("c", "reduces"), cite("x", "permits")])),
        ("conditional", dict(cuts=[("c", "not_raised", 0)], cites=[cite("c", "reduces")])),
    ]
    got = verdicts.correct_verdicts(rows_of(spark, cases)).orderBy("answer_id").collect()
    assert [r.verdict for r in got] == [
        "insufficient_information", "covered", "insufficient_information", "conditional", "insufficient_information",
        "conditional", "conditional"]
    assert got[1].cites[0].effect == "permits" and not got[2].cites
    assert [[c.clause_id for c in r.cites] for r in got[5:]] == [["x"], ["c"]]


def test_second_answer_replaces_a_contradicted_one(spark):
    rows = rows_of(spark, [("covered", dict(cuts=[("c", "applies", 0)], cites=[cite("x", "permits")]))])
    second = rows.select("answer_id", F.lit("not_covered").alias("verdict"), "cites")
    assert verdicts.correct_verdicts(rows, second).collect()[0].verdict == "not_covered"


def test_content_keys_ignore_field_order_inside_messages(spark):
    from pyspark.sql import types as T

    def key(*names):
        kind = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))
        said = F.array(F.struct(*[F.lit({"role": "user", "content": "hi"}[n]).alias(n) for n in names]))
        return spark.range(1).select(responses.content_key(
            F.lit("m"), said, F.lit("s"), F.lit("o"), messages_type=kind)).collect()[0][0]
    assert key("role", "content") == key("content", "role")


def test_content_keys_ignore_map_order_and_default_precision(spark):
    df = spark.range(1)
    def key(options, precision=None):
        return df.select(responses.content_key(
            F.lit("m"), F.lit("text"), F.lit("s"), responses.sorted_map(options), precision)).collect()[0][0]
    one = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    two = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    assert key(one) == key(two) == key(one, F.lit("f16")) != key(one, F.lit("q8"))
