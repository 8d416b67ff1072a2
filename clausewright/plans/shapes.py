"""The given tables read as policies, written once for Spark and for the oracle.

The given tables hold prose, orders and events, but no policies. These
expressions turn every row of them into the shapes the library works on:
documents get section titles, clause numbers and policy phrases at fixed places;
orders become claims and parts become policies. Nothing is left out: every
document, line, order and event takes part. The expressions are plain SQL that
both engines read the same way, with `{i}` the 0-based line number and `{d}` the
document id.
"""

from __future__ import annotations


def _cases(selector: str, values: dict[int, str], default: str = "''") -> str:
    whens = " ".join(f"when {n} then {v}" for n, v in values.items())
    return f"case cast({selector} as int) {whens} else {default} end"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TITLES = {
    0: "WAITING PERIODS", 1: "EXCLUSIONS", 2: "BENEFITS", 3: "GENERAL CONDITIONS",
    4: "CLAIM PROCEDURE", 5: "D E F I N I T I O N S",
}
TAILS = {
    0: " It is subject to Clause 2 and is read as defined in Section 3.",
    1: " This does not extend to nursing except dental repair.",
    2: " A waiting period of 24 months runs from the date of inception.",
    3: " Costs up to 30 days prior to the date of admission are met.",
    4: " Refer to Annexure III and Annexure IV for the list.",
    5: " The following apply:",
    6: " Room rent is limited to 2% of the sum insured per day.",
    7: " Day care means treatment finished in under 24 hours.",
    8: " Costs are met for 60 days after discharge and the daily rate is capped.",
    9: " Cover is specified in schedule B in accordance with section 4, under clause 7.",
    10: " None is paid for self harm, unless caused by an accident;",
    11: " A curly “quote” – with dash, ﬁne ﬂow and pre-",
}


def decorate(x: str, i: str, d: str, newline: str, feed: str) -> str:
    """A document line with its section title, clause number and policy phrase."""
    nine = f"cast(({i} - {i} % 9) / 9 as bigint)"
    third = f"cast(({i} % 9 - {i} % 3) / 3 as bigint)"
    titles = _cases(f"({d} + {nine}) % 6", {k: _q(v) for k, v in TITLES.items()})
    return (
        f"concat("
        f"case when {i} > 0 and {i} % 18 = 0 then {feed} else '' end, "
        f"case when {i} % 9 = 0 then concat('SECTION ', 1 + {nine}, '  ', {titles}, {newline}) "
        f"when {i} % 36 = 20 then concat('Annexure IV - Items not paid', {newline}) "
        f"when {i} % 45 = 32 then concat(2 + {nine}, '. General Conditions', {newline}, "
        f"2 + {nine}, '.1 ') "
        f"when {i} % 27 = 22 then concat('c. Other Benefits:', {newline}) else '' end, "
        f"case when {i} % 27 = 10 then concat('a. Ailments held before: Code – Excl', 1 + {i} % 18, ' ') "
        f"when {i} % 27 = 13 then '\"Sum Assured\" means ' "
        f"when {i} % 9 = 4 then '(a) ' "
        f"when {i} % 9 = 5 then concat('(b)', {newline}) "
        f"when {i} % 9 = 7 then '1. ' when {i} % 9 = 8 then '2. ' "
        f"when {i} % 9 = 1 and {d} % 4 = 1 then '1. ' "
        f"when {i} % 9 = 2 and {d} % 4 = 1 then '3. ' "
        f"when {i} % 3 = 0 then concat(1 + {nine}, '.', 1 + {third}, ' ') else '' end, "
        f"{x}, "
        + _cases(f"({d} * 3 + {i}) % 17", {k: _q(v) for k, v in TAILS.items()})
        + ")"
    )


# Styling and place on the page of a line, from its number and words.
LINE_STYLE = {
    "size": "case when text like 'SECTION %' then cast(14.0 as double) "
            "when (line_no * 7 + doc_id) % 29 = 0 then cast(10.5 as double) else cast(10.0 as double) end",
    "bold": "text like 'SECTION %' or text like 'Annexure IV - %' or text like '\"Sum Assured\"%' "
            "or (doc_id % 2 = 0 and substring(text, 1, 1) between '0' and '9' and line_no % 4 <> 1)",
    "words_bold": "text like 'SECTION %' or text like 'Annexure IV - %' "
                  "or (doc_id % 2 = 0 and substring(text, 1, 1) between '0' and '9' and line_no % 4 = 2)",
    "x0": "cast(case when line_no % 2 = 1 then 120 else 72 end as double)",
    "y0": "cast(14 * (line_no - line_no % 2) as double)",
    "y1": "cast(14 * (line_no - line_no % 2) + 12 as double)",
}

TYPE_OF = {
    0: "coverage", 1: "exclusion", 2: "condition", 3: "sub_limit", 4: "waiting_period",
    5: "definition", 6: "procedural",
}
# The model's reading of a clause, from its place; some clauses have none.
_ANALYSED = "(doc_id + order_idx) % 13 <> 5"
ANALYSIS = {
    "clause_type": f"case when {_ANALYSED} then "
    + _cases("(doc_id + order_idx) % 7", {k: _q(v) for k, v in TYPE_OF.items()}) + " end",
    "likelihood": f"case when {_ANALYSED} then cast(1 + (doc_id * 3 + order_idx) % 5 as int) end",
    "severity": f"case when {_ANALYSED} then cast(1 + (doc_id + order_idx * 2) % 5 as int) end",
}

# --- parts as policies ------------------------------------------------------
# Each part is a policy of fourteen clauses whose terms come from the part.
P, S = "p_partkey", "p_size"
_NULL_INT = "cast(null as int)"
_NULL_STR = "cast(null as varchar(40))"
POLICY_FIELDS = [
    "order_idx", "section_path", "number", "heading", "text", "clause_type", "likelihood", "severity",
    "waiting_period_value", "waiting_period_unit", "copay_percent", "copay_min_age_at_inception",
    "cap_percent_of_sum_insured", "icu_cap_percent_of_sum_insured", "cap_max_inr_per_day",
    "icu_cap_max_inr_per_day", "cover_window_value", "cover_window_unit", "cover_window_anchor",
    "is_heading", "exception", "time_window",
]


def _clause(idx: int, section: str, number: str, heading: str, text: str, kind: str, **terms) -> dict:
    row = {f: _NULL_INT for f in POLICY_FIELDS if f.startswith(("copay", "cap", "icu"))}
    row |= {
        "order_idx": str(idx), "section_path": _q(section), "number": _q(number),
        "heading": _q(heading), "text": text, "clause_type": _q(kind),
        "likelihood": f"cast(1 + ({P} + {idx}) % 5 as int)",
        "severity": f"cast(1 + ({P} * 3 + {idx}) % 5 as int)",
        "waiting_period_value": _NULL_INT, "waiting_period_unit": _NULL_STR,
        "cover_window_value": _NULL_INT, "cover_window_unit": _NULL_STR,
        "cover_window_anchor": _NULL_STR, "is_heading": "false", "exception": _NULL_STR,
        "time_window": _NULL_STR,
    }
    row |= terms
    return {f: row[f] for f in POLICY_FIELDS}


POLICY_CLAUSES = [
    _clause(0, "SECTION 1 BENEFITS", "1", "1 Cover", "concat('1 Cover for ', p_name, ' holders is set out below.')",
            "coverage", is_heading="true"),
    _clause(1, "SECTION 1 BENEFITS", "1.1", "1.1 Hospital stay",
            f"concat('1.1 Hospital stay. In-patient treatment of the holder of a ', p_name, ' is paid. "
            f"Costs met within ', 30 + {S}, ' days immediately after the date of discharge are payable.')",
            "coverage"),
    _clause(2, "SECTION 1 BENEFITS", "1.2", "1.2 Day procedures",
            "'1.2 Day procedures. Short treatment listed in Annexure II is paid, as is dialysis at a listed centre.'",
            "coverage", cover_window_value=f"cast(20 + {S} as int)", cover_window_unit="'days'",
            cover_window_anchor="'before_admission'"),
    _clause(3, "SECTION 2 WAITING PERIODS", "2.1", "2.1 First days waiting period",
            "'2.1 First days waiting period. No claim is paid in the opening days of the cover, except claims "
            "arising from an accident.'",
            "waiting_period", waiting_period_value=f"cast(30 + {S} as int)", waiting_period_unit="'days'",
            exception=f"case when {P} % 2 = 0 then 'arising from an accident' end"),
    _clause(4, "SECTION 2 WAITING PERIODS", "2.2", "2.2 Pre-existing disease waiting period",
            "'2.2 Pre-existing disease waiting period. An ailment held before the cover began is paid after the wait.'",
            "waiting_period", waiting_period_value=f"cast(1 + {S} % 4 as int)", waiting_period_unit="'years'"),
    _clause(5, "SECTION 2 WAITING PERIODS", "2.3", "2.3 Specified disease waiting period",
            "'2.3 Specified disease waiting period of 24 months. List of ailments: cataract, hernia, sinus. "
            "A wait of 36 months holds for joint replacement.'",
            "exclusion"),
    _clause(6, "SECTION 2 WAITING PERIODS", "2.4", "2.4 Two step wait",
            "'2.4 Two step wait. Fractures wait one term and tumours wait the other.'",
            "waiting_period", waiting_period_value=f"cast(6 + {S} % 12 as int)", waiting_period_unit="'months'",
            time_window=f"concat(24 + {S} % 24, ' months')"),
    _clause(7, "SECTION 3 LIMITS", "3.1", "3.1 Co-payment",
            f"concat('3.1 Co-payment. The holder bears ', 10 + {S} % 20, '% of each claim.')",
            "sub_limit", copay_percent=f"cast(10 + {S} % 20 as int)",
            copay_min_age_at_inception=f"case when {P} % 5 <> 0 then cast(40 + {S} % 30 as int) end"),
    _clause(8, "SECTION 3 LIMITS", "3.2", "3.2 Room rent",
            f"concat('3.2 Room rent. The room is paid up to ', 1 + {S} % 3, '% of the sum insured per day.')",
            "sub_limit", cap_percent_of_sum_insured=f"cast(1 + {S} % 3 as int)",
            icu_cap_percent_of_sum_insured=f"case when {P} % 3 <> 0 then cast(2 + {S} % 3 as int) end",
            cap_max_inr_per_day=f"case when {P} % 4 = 0 then cast(1500 + 20 * {S} as int) end",
            icu_cap_max_inr_per_day=f"case when {P} % 4 = 1 then cast(3000 + 20 * {S} as int) end"),
    _clause(9, "SECTION 3 LIMITS", "3.3", "3.3 Named treatment",
            "'3.3 Named treatment. Cataract and knee replacement are paid up to a fixed amount.'",
            "sub_limit"),
    _clause(10, "SECTION 4 EXCLUSIONS", "4.1", "4.1 Drink and drugs",
            "'4.1 Drink and drugs. Loss from the use of alcohol, a narcotic or an intoxicating substance is not paid.'",
            "exclusion"),
    _clause(11, "SECTION 4 EXCLUSIONS", "4.2", "4.2 Offences; looks",
            "'4.2 Offences; looks. Treatment arising from a breach of law with criminal intent, and cosmetic "
            "rhinoplasty unless needed after a burn, are not paid.'",
            "exclusion", exception="'needed after a burn'"),
    _clause(12, "SECTION 4 EXCLUSIONS", "4.2", "4.2 Abroad",
            "'4.2 Abroad. No bill of a hospital outside India is paid, whatever the reason for the journey.'",
            "exclusion"),
    _clause(13, "SECTION 5 CONDITIONS", "", "",
            "'Contribution. Where other insurance covers the same claim a rateable proportion is paid; see Annexure II and Annexure V.'",
            "condition"),
]

# --- orders as claims -------------------------------------------------------
HELD = "datediff_days"
SCENARIOS = {
    0: "I bought this policy and later fell ill with a fever. I have another health insurance policy.",
    1: "I needed cataract surgery at a private clinic. I have no other policy.",
    2: "I was drinking heavily and fell down the stairs after I took the policy out.",
    3: "I was arrested while shoplifting and hurt my knee.",
    4: "I fell ill on holiday in Dubai and was treated there.",
    5: "Pain in my knee began some weeks after I bought the policy, so I am to get a knee replacement.",
    6: "A kidney stone had to be removed; I had never had one and never had pain before buying the policy.",
    7: "My mother, who is 75, broke her hip. A thief hurt her while stealing my bag.",
    8: "I want rhinoplasty. My employer's group insurance cover paid part. I left my old insurer; I hold a second policy.",
    9: "I was in a road accident and needed dialysis at a listed centre in Chennai after a trip to Thailand.",
    10: "I don’t have another policy and had a hernia repair.",
    11: "I had a scan after I was discharged and the room was in intensive care.",
}
PROCEDURES = {
    0: "cataract surgery", 1: "hernia repair", 2: "knee replacement", 3: "dialysis", 4: "rhinoplasty",
    5: "fracture fixing", 6: "unknown",
}
CONDITIONS = {0: "fever", 1: "cataract", 2: "tumours", 3: "kidney stone", 4: ""}

_L, _N, _C = "l_orderkey", "l_linenumber", "o_custkey"


def claim_columns(days_held: str) -> dict[str, str]:
    """The facts of a claim, from a line item and its order; `days_held` is dialect text."""
    unit = f"({_L} + {_N}) % 4"
    money = f"{_L} % 4"
    return {
        "claim_id": f"{_L} * 100000000000 + l_partkey * 1000000 + l_suppkey % 100 * 10000 + cast(l_quantity as bigint) * 100 + {_N}",
        "policy_id": "l_partkey",
        "scenario": _cases(f"({_L} + {_N}) % 12", {k: _q(v) for k, v in SCENARIOS.items()}),
        "procedure": _cases(f"({_L} * 3 + {_N}) % 7", {k: _q(v) for k, v in PROCEDURES.items()}, "null"),
        "condition": _cases(f"({_L} + {_N} * 2) % 6", {k: _q(v) for k, v in CONDITIONS.items()}, "null"),
        "time_since_policy_start_value":
            f"case when {_L} % 11 <> 0 then cast(case when {unit} = 0 then {days_held} "
            f"when {unit} = 1 then {days_held} % 60 when {unit} = 2 then {days_held} % 50 "
            f"else {days_held} % 6 end as int) end",
        "time_since_policy_start_unit":
            _cases(unit, {0: "'days'", 1: "'weeks'", 2: "'months'", 3: "'years'"}, "null"),
        "age": f"case when {_C} % 3 <> 0 then cast(20 + {_C} % 60 as int) end",
        "age_at_policy_start": f"case when {_C} % 4 = 0 then cast(18 + {_C} % 62 as int) end",
        "hospitalised": f"case when {_L} % 5 <> 0 then {_L} % 2 = 0 end",
        "hours_since_admission": f"case when {_L} % 7 = 0 then cast({_N} * 10 as int) end",
        "sum_insured_value":
            f"case when {_L} % 6 <> 0 then cast(case when {money} = 0 then floor(o_totalprice) "
            f"when {money} = 1 then floor(o_totalprice / 1000) when {money} = 2 then 1 + {_C} % 9 "
            f"else 1 end as bigint) end",
        "sum_insured_unit":
            _cases(money, {0: "'rupees'", 1: "'thousand'", 2: "'lakh'", 3: "'crore'"}, "null"),
        "room_rent_per_day_inr":
            f"case when {_N} % 3 <> 0 then cast(floor(l_extendedprice / l_quantity) as bigint) end",
        "room_is_icu": f"case when {_N} % 2 = 0 then {_L} % 3 = 0 end",
        "expense_timing_value": f"case when {_L} % 3 <> 0 then cast({_N} * 9 + {_L} % 20 as int) end",
        "expense_timing_unit": f"case when {_L} % 9 = 1 then 'weeks' else 'days' end",
        "expense_timing_anchor":
            f"case {_L} % 4 when 0 then 'after_discharge' when 1 then 'before_admission' end",
        "condition_known_for_value": f"case when {_L} % 2 = 0 then cast(1 + {_C} % 40 as int) end",
        "condition_known_for_unit": f"case when {_C} % 2 = 0 then 'months' else 'weeks' end",
        "pre_existing_condition":
            f"case when {_L} % 13 = 0 then 'yes' when {_L} % 13 = 1 then 'no' else 'unknown' end",
        "notes": f"case {_L} % 6 when 0 then 'This policy does not cover theft' "
                 f"when 1 then 'the stay will be covered' when 2 then 'seen by a doctor' end",
    }


# --- answers to the claims --------------------------------------------------
VERDICT_OF = {0: "covered", 1: "not_covered", 2: "conditional", 3: "insufficient_information"}
ANSWER = {
    "answer_id": "claim_id",
    "verdict": _cases("(claim_id + policy_id) % 4", {k: _q(v) for k, v in VERDICT_OF.items()}),
    "expected": _cases("(claim_id * 3 + policy_id) % 4", {k: _q(v) for k, v in VERDICT_OF.items()}),
}
EFFECT_OF = {0: "denies", 1: "delays", 2: "reduces", 3: "requires", 4: "permits"}
# Which clause the j-th citation of an answer is of; answers have 0 to 3.
CITED_IDX = "cast((claim_id + j * 5) % 15 as int)"
CITATIONS = "cast((claim_id % 7 + policy_id) % 4 as int)"
EFFECT = _cases("(claim_id + policy_id * j) % 5", {k: _q(v) for k, v in EFFECT_OF.items()})


def quote(newline: str) -> str:
    """A quotation of `text`, exact or damaged, chosen by the claim and citation."""
    n = "cast((claim_id + policy_id + j) % 9 as int)"
    half = "cast(length(text) / 2 as int)"
    mid = "cast(length(text) / 3 as int)"
    return (
        f"case {n} when 0 then text "
        f"when 1 then upper(substring(text, 5, {half} + 8)) "
        f"when 2 then concat(text, ' BY THE COMPANY') "
        f"when 3 then 'The holder may claim twice for each stay without limit.' "
        f"when 4 then '' when 5 then substring(text, 1, 12) "
        f"when 6 then concat(substring(text, 1, {mid} + 10), {newline}, substring(text, {half} + 12, 200)) "
        f"when 7 then concat(replace(text, ' ', '  '), ' [', number, ' (', number, ')]') "
        f"else concat(substring(text, {half}, 200), {newline}, substring(text, 1, {half} - 4)) end"
    )
