"""Shared oracle tables about policies, claims, checks and answers."""

from __future__ import annotations

from clausewright.functions import fixed
from clausewright.plans import shapes
from clausewright.plans.oracle import (
    CTES, _policy_rows, case_of, count, extract, ligatures, matches, plain, q, q_list,
    quotable, stem_list,
)


# Budgets small enough that the policies of the given tables do not all fit.
SMALL_BUDGET = 220
SMALL_GROUP = 120


def days(value: str, unit: str, table: dict) -> str:
    return f"case when {value} > 0 then {value} * {case_of(unit, table)} end"


def one_line(c: str) -> str:
    return rf"trim(regexp_replace({ligatures(c)}, '\s+', ' ', 'g'))"


def split_sentences(c: str) -> str:
    return rf"string_split(regexp_replace({c}, '([.;!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def word_list(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[a-z]{{4,}}'))"


_LIST_TO_END = r"(?is)" + fixed.RE_LIST_STARTS.replace("(?i)", "") + ".*$"
_ICU_PCT = "case when is_icu then icu_cap_percent_of_sum_insured else cap_percent_of_sum_insured end"
_ICU_MAX = "case when is_icu then icu_cap_max_inr_per_day else cap_max_inr_per_day end"
_DESCRIBED = "concat(coalesce(procedure, ''), ' ', coalesce(condition, ''))"
_STATED_GAP = {
    "time_since_policy_start_value": "time_since_policy_start_value is null",
    "age": "age is null",
    "pre_existing_condition": "coalesce(pre_existing_condition in ('', 'unknown'), true)",
    "hospitalised": "hospitalised is null",
    "hours_since_admission": "hours_since_admission is null",
}
_GENERIC_STEMS = sorted({w[: fixed.STEM_CHARS] for w in fixed.GENERIC_WORDS if len(w) >= 5})


def stem_pairs(c: str) -> str:
    """(stem, first word) of a text."""
    words = (
        f"list_filter(regexp_extract_all(lower({ligatures(c)}), '{fixed.RE_STEM_WORD}'), "
        f"lambda w: w not in {q_list(fixed.FUNCTION_WORDS)})"
    )
    return words


CTES |= {
    "v_pclauses": _policy_rows(),
    "v_policies": f"""
      select *, round(cast(coalesce({case_of('clause_type', fixed.TYPE_WEIGHT)}, {fixed.OTHER_TYPE_WEIGHT}) as double)
          * ((likelihood + severity) / 2.0::double) * 20.0::double, 6) as impact,
        case when exception is null then [] else [exception] end as exceptions,
        {days('cover_window_value', 'cover_window_unit', fixed.PERIOD_DAYS)} as cover_window_days,
        case when wait_days is null then [] else list_sort(list_distinct(list_filter([wait_days,
          case when {matches("trim(time_window)", fixed.RE_BARE_DURATION)} then
            cast({extract("trim(time_window)", fixed.RE_BARE_DURATION, 1)} as int)
            * {case_of("concat(lower(" + extract("trim(time_window)", fixed.RE_BARE_DURATION, 2) + "), 's')", fixed.PERIOD_DAYS)} end],
          lambda d: d > 0))) end as waiting_periods_days
      from (
        select *, case when rep = 1 then base else concat(base, '#', rep) end as clause_id,
          {days('waiting_period_value', 'waiting_period_unit', fixed.PERIOD_DAYS)} as wait_days
        from (
          select *, row_number() over (partition by policy_id, base order by order_idx) as rep
          from (select *, case when number <> '' then number else concat('c', order_idx) end as base from v_pclauses)))
      where not is_heading""",
    "v_claims": "select "
    + ", ".join(
        f"{sql} as {name}"
        for name, sql in shapes.claim_columns("cast(date_diff('day', o_orderdate, l_shipdate) as int)").items()
    )
    + " from lineitem join orders on l_orderkey = o_orderkey",
    "v_facts": f"""
      select * replace ({plain('scenario')} as scenario),
        cast({days('time_since_policy_start_value', 'time_since_policy_start_unit', fixed.CLAIM_DAYS)} as bigint) as held_days,
        cast({days('expense_timing_value', 'expense_timing_unit', fixed.CLAIM_DAYS)} as bigint) as expense_days,
        cast({days('condition_known_for_value', 'condition_known_for_unit', fixed.CLAIM_DAYS)} as bigint) as known_days,
        cast({days('sum_insured_value', 'sum_insured_unit', fixed.MONEY_UNITS)} as bigint) as sum_insured_rupees
      from v_claims""",
    "v_repaired": f"""
      select * exclude (misfiled) replace (
        case when misfiled then age_at_policy_start else age end as age,
        case when not misfiled then age_at_policy_start end as age_at_policy_start,
        case when pre_existing_condition <> 'unknown' then pre_existing_condition
          when known_days > held_days then 'yes' when known_days < held_days then 'no'
          when {matches('scenario', fixed.RE_STATED_NEW)} then 'no' else 'unknown' end as pre_existing_condition)
      from (
        select *, coalesce(age_at_policy_start, 0) <> 0 and coalesce(age, 0) = 0
          and not {matches('scenario', fixed.RE_START_WORDS)} as misfiled
        from v_facts)""",
    "v_prepared": f"""
      select *, list_filter([{", ".join(f"case when {sql} then {q(n)} end" for n, sql in _STATED_GAP.items())}],
          lambda x: x is not null) as missing_facts,
        cast(case when age_at_policy_start > 0 then age_at_policy_start
          when age > 0 and age - floor(held_days / 365) > 0 and age - floor(held_days / 365) <= age
          then age - floor(held_days / 365) end as bigint) as inception_age
      from v_repaired""",
    "v_wait_clauses": f"""
      select policy_id, clause_id, order_idx, clause_type, required_days, exceptions,
        listed, {matches('left(txt, 60)', fixed.RE_PRE_EXISTING)} as pre_existing,
        case when listed and length(listing) <= {fixed.QUOTED_LIST_CHARS} then listing else '' end as listing,
        regexp_replace(head, {q(fixed.RE_HEADING_NUMBER)}, '') as subject
      from (
        select *, {matches("concat(head, ' ', left(txt, 60))", fixed.RE_LISTED)}
            or (section_path <> '' and not {matches('section_path', fixed.RE_GENERAL_SECTION)}) as listed,
          case when {matches('body', fixed.RE_LIST_STARTS)} then {extract('body', _LIST_TO_END)} else body end as listing
        from (
          select *, trim(case when starts_with(txt, head) then substring(txt, length(head) + 1) else txt end) as body,
            list_sort(list_distinct(case when len(stated) > 0 then stated
              when {matches('head', fixed.RE_HEADED_WAIT)} then list_transform(
                list_zip(regexp_extract_all(txt, {q(fixed.RE_DURATION)}, 1), regexp_extract_all(txt, {q(fixed.RE_DURATION)}, 2)),
                lambda p: cast(p[1] as int) * {case_of("concat(lower(p[2]), 's')", fixed.PERIOD_DAYS)}) else [] end)) as required_days
          from (
            select *, trim({ligatures('heading')}) as head, {one_line('text')} as txt,
              list_filter(waiting_periods_days, lambda d: d > 0) as stated
            from v_policies)))
      where len(required_days) > 0 and {count('txt', fixed.RE_MEANS)} < {fixed.DEFINITIONS_BLOCK}
        and {matches("concat(head, ' ', txt)", fixed.RE_WAITS)}""",
    "v_waits": """
      select c.claim_id, c.policy_id, c.held_days, coalesce(c.pre_existing_condition, 'unknown') as condition_predates,
        w.* exclude (policy_id),
        case when held_days is null then 'unknown' when held_days >= list_max(required_days) then 'served'
          when held_days < list_min(required_days) then 'not_served' else 'partly_served' end as status
      from v_prepared c join v_wait_clauses w on w.policy_id = c.policy_id""",
    "v_window_clauses": f"""
      select policy_id, clause_id, order_idx, clause_type, cast(window_days as bigint) as window_days, anchor from (
        select *, case when reads then cast({extract('txt', fixed.RE_STATED_WINDOW, 1)} as bigint) else cover_window_days end as window_days,
          case when reads then case when contains(lower({extract('txt', fixed.RE_STATED_WINDOW)}), 'discharge')
            then 'after_discharge' else 'before_admission' end else cover_window_anchor end as anchor
        from (
          select *, {one_line('text')} as txt, coalesce(cover_window_days, 0) = 0 and clause_type = 'coverage'
            and {matches('txt', fixed.RE_STATED_WINDOW)} as reads
          from v_policies))
      where window_days > 0 and anchor in ('before_admission', 'after_discharge')""",
    "v_windows": """
      select c.claim_id, c.policy_id, c.expense_days, w.* exclude (policy_id),
        case when c.expense_timing_anchor is distinct from w.anchor then 'not_raised'
          when expense_days is null then 'unknown' when expense_days <= window_days then 'within' else 'outside' end as status
      from v_prepared c join v_window_clauses w on w.policy_id = c.policy_id""",
    "v_cuts": f"""
      select claim_id, policy_id, clause_id, order_idx, clause_type, kind,
        case kind when 'copay' then case when copay_min_age_at_inception is null then 'applies'
            when inception_age is null then case when coalesce(age, 0) = 0 and coalesce(age_at_policy_start, 0) = 0
              then 'not_raised' else 'unknown' end
            when inception_age >= copay_min_age_at_inception then 'applies' else 'does_not_apply' end
          when 'room_cap' then case when sum_insured_rupees is null and coalesce(room_rent_per_day_inr, 0) = 0 then 'not_raised'
            when sum_insured_rupees is null or coalesce(room_rent_per_day_inr <= 0, true) then 'unknown'
            when room_rent_per_day_inr > limit_inr then 'applies' else 'does_not_apply' end
          else 'judgement' end as status,
        case when kind = 'other_cap' then list_sort(list_filter({word_list(_DESCRIBED)},
          lambda w: w not in {q_list(fixed.GENERIC_WORDS)} and list_contains({word_list('text')}, w))) else [] end as named,
        copay_percent, copay_min_age_at_inception, inception_age, cap_percent, cap_max, is_icu, sum_insured_rupees,
        room_rent_per_day_inr, limit_inr
      from (
        select *, case when kind = 'room_cap' and sum_insured_rupees is not null then
            least(sum_insured_rupees * cap_percent // 100, case when coalesce(cap_max, 0) <> 0 then cap_max end) end as limit_inr
        from (
          select *, case when coalesce(copay_percent, 0) <> 0 then 'copay' when coalesce(cap_percent, 0) <> 0 then 'room_cap'
              when clause_type = 'sub_limit' then 'other_cap' end as kind
          from (
            select p.*, c.* exclude (policy_id), coalesce(room_is_icu, false) as is_icu,
              {_ICU_PCT} as cap_percent, {_ICU_MAX} as cap_max
            from v_prepared c join v_policies p on p.policy_id = c.policy_id)))
      where kind is not null""",
    "v_rare": f"""
      select policy_id, stem, unnest(ids) as clause_id from (
        select policy_id, stem, list(clause_id) as ids
        from (select policy_id, clause_id, unnest({stem_list('text')}) as stem from v_policies)
        group by policy_id, stem having count(*) <= {fixed.RARE_CLAUSES})""",
    "v_said": f"""
      select claim_id, policy_id, substring(word, 1, {fixed.STEM_CHARS}) as stem, arg_min(word, at_) as word from (
        select claim_id, policy_id, unnest({stem_pairs('scenario')}) as word,
          generate_subscripts({stem_pairs('scenario')}, 1) as at_ from v_prepared)
      group by all""",
    "v_told": f"""
      select claim_id, policy_id, substring(word, 1, {fixed.STEM_CHARS}) as stem, arg_min(word, at_) as word from (
        select claim_id, policy_id, unnest({stem_pairs(_DESCRIBED)}) as word,
          generate_subscripts({stem_pairs(_DESCRIBED)}, 1) as at_ from v_prepared)
      group by all""",
    "v_shared": f"""
      select claim_id, policy_id, clause_id, count(*) as shared, list_sort(list(distinct word)) as words
      from v_said join v_rare using (policy_id, stem) group by all having count(*) >= {fixed.MIN_SHARED}""",
    "v_named": f"""
      select claim_id, policy_id, clause_id, count(*) as shared, list_sort(list(distinct word)) as words
      from v_told join v_rare using (policy_id, stem) join v_policies p using (policy_id, clause_id)
      where p.clause_type not in {q_list(fixed.DROPPED_FIRST)} group by all""",
    "v_excluding": f"""
      select n.claim_id, n.policy_id, n.clause_id, n.words from v_named n
      join v_policies p using (policy_id, clause_id) join v_prepared c on c.claim_id = n.claim_id
      where p.clause_type = 'exclusion' and not list_has_any(
        flatten(list_transform(p.exceptions, lambda e: {stem_list('e')})),
        list_filter({stem_list('c.scenario')}, lambda s: s not in {q_list(_GENERIC_STEMS)}))""",
    "v_triggers": f"""
      with asked as (
        select claim_id, policy_id, {matches('scenario', fixed.RE_ASKS_HOME)} as home, unnest([
          case when len(list_filter({split_sentences('scenario')}, lambda s: {matches('s', fixed.RE_ASKS_OTHER_POLICY)}
            and not {matches('s', fixed.RE_NOT_HELD)})) > 0 then 'another_policy' end,
          case when {matches('scenario', fixed.RE_ASKS_ABROAD)} then 'abroad' end,
          case when {matches('scenario', fixed.RE_ASKS_INTOXICATION)} then 'intoxication' end,
          case when {matches('scenario', fixed.RE_ASKS_OFFENCE)} or {count('scenario', fixed.RE_ASKS_WHILE_OFFENCE)}
            > {count('scenario', fixed.RE_WHILE_OFFENCE_ON_US)} then 'breach_of_law' end]) as rule from v_prepared),
      ruled as (
        select policy_id, clause_id, order_idx, text, unnest([
          case when {matches('text', fixed.RE_CLAUSE_OTHER_POLICY)} then 'another_policy' end,
          case when {matches('text', fixed.RE_CLAUSE_ABROAD)} then 'abroad' end,
          case when clause_type = 'exclusion' and {matches('text', fixed.RE_CLAUSE_INTOXICATION)} then 'intoxication' end,
          case when clause_type = 'exclusion' and {matches('text', fixed.RE_CLAUSE_BREACH)} then 'breach_of_law' end]) as rule
        from v_policies)
      select claim_id, policy_id, rule, clause_id, order_idx, rule = 'abroad' and home as at_home, case when rule = 'breach_of_law' then
        trim(regexp_replace({extract('text', fixed.RE_CLAUSE_BREACH)}, '\\s+', ' ', 'g')) end as quoted
      from asked join ruled using (policy_id, rule)""",
    "v_absent": f"""
      select distinct policy_id, clause_id, order_idx, label from (
        select policy_id, clause_id, order_idx, unnest(list_transform(regexp_extract_all(text, {q(fixed.RE_ANNEXURE)}, 1), lambda x: upper(x))) as label from v_policies) n
      where not exists (
        select 1 from (select policy_id, unnest(list_transform(regexp_extract_all(section_path, {q(fixed.RE_ANNEXURE)}, 1), lambda x: upper(x))) as label from v_policies) s
        where s.policy_id = n.policy_id and s.label = n.label)""",
    "v_named_any": """
      select claim_id, policy_id, clause_id from v_waits
      union select claim_id, policy_id, clause_id from v_cuts where status <> 'not_raised'
      union select claim_id, policy_id, clause_id from v_windows where status <> 'not_raised'
      union select claim_id, policy_id, clause_id from v_shared
      union select claim_id, policy_id, clause_id from v_named
      union select claim_id, policy_id, clause_id from v_triggers
      union select c.claim_id, c.policy_id, a.clause_id from v_prepared c join v_absent a using (policy_id)""",
    "v_costs": f"""
      select policy_id, order_idx, clause_id, clause_type, impact, length(text) as chars,
        cast(floor(length(text) / {fixed.CHARS_PER_TOKEN}::double) as bigint) + {fixed.CLAUSE_HEADER_TOKENS} as cost from v_policies""",
    "v_ranked": f"""
      select claim_id, policy_id, order_idx, chars, cost, clause_type, count(*) over (partition by claim_id) as items,
        row_number() over (partition by claim_id order by keep is null, clause_type in {q_list(fixed.DROPPED_FIRST)}, -impact, order_idx) as rn
      from (
        select c.claim_id, k.*, s.clause_id as keep from v_prepared c join v_costs k using (policy_id)
        left join (select claim_id, clause_id from v_shared union select claim_id, clause_id from v_named) s
          on s.claim_id = c.claim_id and s.clause_id = k.clause_id)""",
    # The fold, one clause per step: an item that does not fit is skipped.
    "v_fit": """
      select claim_id, cast(0 as bigint) as step, cast(0 as bigint) as used, cast(0 as bigint) as chars_in, cast([] as int[]) as kept
      from v_prepared
      union all
      select f.claim_id, r.rn, case when f.used + r.cost > {BUDGET} and len(f.kept) > 0 then f.used else f.used + r.cost end,
        case when f.used + r.cost > {BUDGET} and len(f.kept) > 0 then f.chars_in else f.chars_in + r.chars end,
        case when f.used + r.cost > {BUDGET} and len(f.kept) > 0 then f.kept else list_append(f.kept, cast(r.order_idx as int)) end
      from v_fit f join v_ranked r on r.claim_id = f.claim_id and r.rn = f.step + 1""".replace("{BUDGET}", str(SMALL_BUDGET)),
    "v_fitted": """
      select f.claim_id, any_value(r.policy_id) as policy_id, f.used, f.chars_in, list_sort(f.kept) as kept, count(*) as clauses,
        sum(r.cost) as all_tokens, count(distinct r.clause_type) filter (not list_contains(f.kept, cast(r.order_idx as int))) as types_dropped
      from v_fit f join v_ranked r on r.claim_id = f.claim_id where f.step = r.items group by f.claim_id, f.used, f.chars_in, f.kept""",
    "v_steps": "select *, row_number() over (partition by policy_id order by order_idx) as rn from v_costs",
    "v_packed": f"""
      select policy_id, cast(0 as bigint) as step, cast(0 as bigint) as used, 0 as group_no, -1 as order_idx
      from (select distinct policy_id from v_costs)
      union all
      select p.policy_id, s.rn, case when p.used > 0 and p.used + s.cost > {SMALL_GROUP} then s.cost else p.used + s.cost end,
        case when p.used > 0 and p.used + s.cost > {SMALL_GROUP} then p.group_no + 1 else p.group_no end, cast(s.order_idx as int)
      from v_packed p join v_steps s on s.policy_id = p.policy_id and s.rn = p.step + 1""",
    "v_answers": "select claim_id, policy_id, scenario, "
    + ", ".join(f"{sql} as {name}" for name, sql in shapes.ANSWER.items())
    + " from v_claims",
    "v_citations": f"""
      select answer_id, claim_id, policy_id, cast(j as int) as pos, coalesce(clause_id, '9.9') as clause_id,
        case when clause_id is null then 'A clause that is not in the policy at all, quoted at length.'
          else {shapes.quote('chr(10)')} end as quote, effect
      from (
        select a.*, p.clause_id, p.text, p.number
        from (select *, {shapes.CITED_IDX} as order_idx, {shapes.EFFECT} as effect from (
          select claim_id, policy_id, answer_id, unnest(range(1, {shapes.CITATIONS} + 1)) as j from v_answers
          where {shapes.CITATIONS} > 0)) a
        left join v_policies p on p.policy_id = a.policy_id and p.order_idx = a.order_idx)""",
    "v_audit_base": f"""
      select c.*, p.clause_type, {quotable('p.text')} as hay, trim(regexp_replace({quotable('c.quote')}, {q(fixed.RE_TRAILING_REF)}, '')) as needle,
        list_filter(list_transform(string_split(c.quote, chr(10)), lambda l: {quotable('l')}), lambda l: l <> '') as pieces,
        list_filter(regexp_split_to_array(trim(c.quote), '\\s+'), lambda t: t <> '') as toks
      from v_citations c left join v_policies p on p.policy_id = c.policy_id and p.clause_id = c.clause_id""",
    # Elision in order: fold the pieces over the text that is left after each.
    "v_audit_elided": f"""
      select *, len(pieces) >= 2 and len(list_filter(pieces, lambda l: length(l) < {fixed.MIN_QUOTE_CHARS})) = 0
        and list_reduce(list_prepend(hay, pieces), lambda rest, piece: case
          when rest is null or strpos(rest, piece) = 0 then null
          else substring(rest, strpos(rest, piece) + length(piece)) end) is not null as is_elided
      from v_audit_base""",
    "v_audit": f"""
      select answer_id, claim_id, policy_id, pos, clause_id, clause_type, effect,
        reason0 = '' or kept is not null as verified, case when kept is not null then '' else reason0 end as reason,
        kept is not null as trimmed, coalesce(kept, quote) as quote
      from (
        select *, case when reason0 <> '' and hay is not null then list_filter(
            list_transform(range(len(toks) - 1, 0, -1), lambda k: regexp_replace(array_to_string(toks[1:k], ' '), '[ ,;:]+$', '')),
            lambda s: length({quotable('s')}) >= {fixed.MIN_QUOTE_CHARS}
              and length({quotable('s')}) >= {fixed.MIN_KEPT_SHARE}::double * length({quotable('quote')})
              and contains(hay, {quotable('s')}))[1] end as kept
        from (
          select *, case when hay is null then 'unknown clause'
              when trim(regexp_replace(coalesce(quote, ''), '\\s+', ' ', 'g')) = '' then 'empty'
              when length(needle) < {fixed.MIN_QUOTE_CHARS} then 'too short'
              when contains(hay, needle) then '' when coalesce(is_elided, false) then '' else 'not found' end as reason0
          from v_audit_elided))""",
}


def _time(d: str) -> str:
    """A number of days in words: whole years, else whole months, else days."""
    def worded(n: str, unit: str) -> str:
        return f"concat({n}, ' {unit}', case when {n} = 1 then '' else 's' end)"

    return (
        f"case when {d} is null then 'an unstated time' when {d} >= 365 and {d} % 365 = 0 then {worded(f'{d} // 365', 'year')} "
        f"when {d} >= 30 and {d} % 30 = 0 then {worded(f'{d} // 30', 'month')} else {worded(d, 'day')} end"
    )


def _times(days_: str) -> str:
    return f"array_to_string(list_transform({days_}, lambda d: {_time('d')}), ' or ')"


def _money(n: str) -> str:
    return (
        f"case when {n} >= 10000000 and {n} % 10000000 = 0 then concat({n} // 10000000, ' crore') "
        f"when {n} >= 100000 and {n} % 100000 = 0 then concat({n} // 100000, ' lakh') else concat({n}, ' rupees') end"
    )


CTES |= {
    # The lines a claim's checks give; a check that settles nothing has a null line.
    "v_wait_lines": f"""
      select claim_id, 1 as block, rank,
        case when rank >= 3 then (case when named then 0 else 2 end) + cast(pre_existing as int) else 0 end as minor, order_idx, clause_id,
        case when rank = 0 then null
          when status = 'partly_served' then concat(who, ': the wait of ', {_times('list_filter(required_days, lambda x: x <= held_days)')},
            ' is over after ', held, '; the wait of ', {_times('list_filter(required_days, lambda x: x > held_days)')}, ' is not')
          when is_new then concat(who, ': for earlier ailments only; this one began later')
          when pre_existing and condition_predates = 'yes' and status = 'not_served'
            then concat(who, ': the ailment came first and ', held, ' of ', need, ' has passed: it bars the claim')
          when pre_existing and status <> 'served' then concat(who, ': for earlier ailments only; needs ', need, ', held ', held)
          when status = 'unknown' then concat(who, ': needs ', need, '; time held not stated')
          when status = 'served' then concat(who, ': the wait of ', need, ' is over after ', held)
          when listed and not named and len(exceptions) = 0 then concat(who, ': bars only what it lists; needs ', need, ', held ', held,
            case when listing <> '' then concat('; it lists: ', listing) else '' end)
          else concat(who, ': needs ', need, ', held ', held, ': it bars the claim',
            case when len(exceptions) > 0 then concat(' except ', array_to_string(exceptions, '; ')) else '' end) end as line
      from (
        select *, case when is_new then 1 when status = 'served' and named then 2 when status = 'served' then 0
            when status in ('not_served', 'partly_served') then 3 else 4 end as rank
        from (
          select w.*, n.clause_id is not null as named, w.pre_existing and w.condition_predates = 'no' as is_new,
            {_times('w.required_days')} as need, {_time('w.held_days')} as held,
            concat('clause ', w.clause_id, case when w.subject <> '' then concat(' (', w.subject, ')') else '' end) as who
          from v_waits w left join v_named n on n.claim_id = w.claim_id and n.clause_id = w.clause_id))""",
    "v_cut_lines": f"""
      select claim_id, 2 as block, case when status = 'applies' then 1 when status = 'unknown' then 2 when kind = 'room_cap' then 3
          when status = 'does_not_apply' then 0 when len(named) > 0 then 4 end as rank, 0 as minor, order_idx, clause_id,
        case when kind = 'copay' then case status
            when 'applies' then case when copay_min_age_at_inception is null then concat(who, copay_percent, '% co-payment on every claim that is paid')
              else concat(who, copay_percent, '% co-payment applies: aged ', inception_age, ' at the start, limit ', copay_min_age_at_inception) end
            when 'unknown' then concat(who, copay_percent, '% co-payment cannot be settled: age at the start not stated') end
          when kind = 'room_cap' then case status
            when 'applies' then concat(who, cap, '; charged ', {_money('room_rent_per_day_inr')}, ', over it')
            when 'unknown' then concat(who, room, ' cap cannot be settled: a figure is missing')
            when 'does_not_apply' then concat(who, cap, '; charged ', {_money('room_rent_per_day_inr')}, ', within it') end
          when status = 'judgement' and len(named) > 0 then concat(who, 'limits ', array_to_string(named, ', '), '; read it') end as line
      from (
        select * replace (cast(limit_inr as bigint) as limit_inr), concat('clause ', clause_id, ': ') as who,
          case when is_icu then 'intensive care' else 'room' end as room,
          concat(cap_percent, '% of ', {_money('sum_insured_rupees')}, ' allows ', {_money('cast(limit_inr as bigint)')}, ' a day for ',
            case when is_icu then 'intensive care' else 'room' end) as cap
        from v_cuts where status <> 'not_raised')
      where rank is not null""",
    "v_window_lines": """
      select claim_id, 3 as block, 1 as rank, 0 as minor, order_idx, clause_id,
        concat('clause ', clause_id, ': pays within ', window_days, ' days ',
          case when anchor = 'after_discharge' then 'after discharge' else 'before admission' end, '; ',
          case status when 'outside' then concat(expense_days, ' days is outside') when 'within' then concat(expense_days, ' days is within')
            else 'how many days is not stated' end) as line
      from v_windows where status <> 'not_raised'""",
    "v_lines_of_claims": """
      select claim_id, block, rank, minor, order_idx, clause_id, line from v_wait_lines
      union all select claim_id, block, rank, minor, order_idx, clause_id, line from v_cut_lines
      union all select claim_id, block, rank, minor, order_idx, clause_id, line from v_window_lines
      union all select claim_id, 4, case rule when 'another_policy' then 1 else 2 end, 0, order_idx, clause_id, concat('clause ', clause_id,
        case when rule = 'another_policy' then ': shares the bill with the other policy that is mentioned'
          when at_home then ': about treatment abroad; home is named too, so settle first where the treatment was'
          else ': bars treatment abroad, and a place abroad is named' end)
      from v_triggers where rule in ('another_policy', 'abroad')""",
    # The same fold as v_fit, for policies without a claim.
    "v_policy_rank": f"""
      select policy_id, order_idx, cost,
        row_number() over (partition by policy_id order by clause_type in {q_list(fixed.DROPPED_FIRST)}, -impact, order_idx) as rn from v_costs""",
    "v_policy_fit": f"""
      select policy_id, cast(0 as bigint) as step, cast(0 as bigint) as used, cast([] as int[]) as kept from (select distinct policy_id from v_costs)
      union all
      select f.policy_id, r.rn, case when f.used + r.cost > {SMALL_BUDGET} and len(f.kept) > 0 then f.used else f.used + r.cost end,
        case when f.used + r.cost > {SMALL_BUDGET} and len(f.kept) > 0 then f.kept else list_append(f.kept, cast(r.order_idx as int)) end
      from v_policy_fit f join v_policy_rank r on r.policy_id = f.policy_id and r.rn = f.step + 1""",
}
