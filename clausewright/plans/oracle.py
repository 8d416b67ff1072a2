"""The same results in DuckDB SQL: shared tables as CTEs, composed per query."""

from __future__ import annotations

import re

from clausewright.functions import fixed
from clausewright.functions import text as tx
from clausewright.plans import shapes
from clausewright.sources import lines as ln


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def q_list(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def plain(c: str) -> str:
    out = f"translate({c}, {q(tx.TRANSLATE_FROM)}, {q(tx.TRANSLATE_TO)})"
    for fancy, simple in tx.EXPANSIONS.items():
        out = f"replace({out}, {q(fancy)}, {q(simple)})"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def normal(c: str) -> str:
    return f"lower({plain(c)})"


def ligatures(c: str) -> str:
    for fancy, simple in tx.EXPANSIONS.items():
        c = f"replace({c}, {q(fancy)}, {q(simple)})"
    return c


def quotable(c: str) -> str:
    # RE2 has no look-around: a hyphen between word characters is rejoined by captures,
    # twice, for words of one letter between two hyphens.
    pat = r"'([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])'"
    one = f"regexp_replace({normal(c)}, {pat}, '\\1-\\2', 'g')"
    return f"regexp_replace({one}, {pat}, '\\1-\\2', 'g')"


def readable(c: str) -> str:
    pat = r"'([A-Za-z])-[ \t]*\n\s*([A-Za-z])'"
    one = f"regexp_replace({ligatures(c)}, {pat}, '\\1-\\2', 'g')"
    return f"regexp_replace({one}, {pat}, '\\1-\\2', 'g')"


def matches(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def extract(c: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({c}, {q(pattern)}, {group})"


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


def stem_list(c: str) -> str:
    return (
        f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({ligatures(c)}), "
        f"'{fixed.RE_STEM_WORD}'), lambda w: w not in {q_list(fixed.FUNCTION_WORDS)}), "
        f"lambda w: substring(w, 1, {fixed.STEM_CHARS})))"
    )


def case_of(c: str, table: dict) -> str:
    whens = " ".join(f"when {q(str(k))} then {v}" for k, v in table.items())
    return f"case {c} {whens} end"


def unescape(c: str) -> str:
    ref = q(f"&(?:{ln.RE_REFERENCE})")
    names, chars = (f"[{', '.join(map(q, part))}]" for part in (ln.ENTITIES, ln.ENTITIES.values()))
    number = (
        "case when lower(r[2:3]) = '#x' then cast('0x' || r[4:-2] as bigint) when r[2] = '#' then cast(r[3:-2] as bigint) end")
    char = (
        f"case when {number} is null then {chars}[list_position({names}, r[2:-2])] "
        f"when {number} between 1 and 55295 or {number} between 57344 and 1114111 then chr(cast({number} as int)) end")
    told = f"list_transform(regexp_extract_all({c}, {ref}), lambda r: coalesce({char}, r))"
    parts = f"regexp_split_to_array({c}, {ref})"
    return f"array_to_string(flatten(list_transform(list_zip({parts}, {told}), lambda x: [coalesce(x[1], ''), coalesce(x[2], '')])), '')"


def despaced(c: str) -> str:
    tokens = rf"regexp_split_to_array(trim({c}), '\s+')"
    words = (
        rf"list_transform(regexp_split_to_array(trim({c}), '\s{{2,}}'), "
        rf"lambda w: regexp_replace(w, '\s+', '', 'g'))"
    )
    return (
        f"case when len({tokens}) >= {fixed.SPACED_MIN_TOKENS} and "
        f"len(list_filter({tokens}, lambda t: length(t) = 1)) / len({tokens}) > {fixed.SPACED_SHARE} "
        f"then array_to_string({words}, ' ') else {c} end"
    )


def _style() -> str:
    return ", ".join(f"{sql} as {name}" for name, sql in shapes.LINE_STYLE.items())


def _policy_rows() -> str:
    return " union all ".join(
        "select p_partkey as policy_id, " + ", ".join(f"{sql} as {name}" for name, sql in c.items()) + " from part"
        for c in shapes.POLICY_CLAUSES
    )


_L = fixed.CLAUSE_MAX_CHARS


def _pieces(source: str, name: str) -> dict[str, str]:
    """B9 as a recursive table: one step per piece."""
    sentence = f"length({extract('left(rest, ' + str(_L) + ')', fixed.RE_SENTENCE_LINE_END, 1)})"
    newline = f"{_L} - strpos(reverse(left(rest, {_L})), chr(10))"
    cut = (
        f"case when length(rest) <= {_L} then length(rest) "
        f"when {sentence} >= {_L // 2} then {sentence} "
        f"when strpos(left(rest, {_L}), chr(10)) > 0 and {newline} > 0 then {newline} else {_L} end"
    )
    cols = "doc_id, is_clause, page_start, page_end, number, section_path"
    return {
        name + "_cut": f"""
            select {cols}, heading, char_start as origin, char_end as ends, text as rest, 0 as done, 0 as n, joint,
              case when is_clause then {cut} else length(rest) end as cut
            from (select *, text as rest from {source})
            union all
            select {cols}, heading, origin, ends, rest, done, n, joint,
              {cut} as cut
            from (
              select {cols}, heading, origin, ends, substring(rest, cut + 2) as rest, done + cut + 1 as done, n + 1 as n,
                substring(rest, cut + 1, 1) as joint
              from {name}_cut where cut + 1 < length(rest))""",
        name: f"""
            select doc_id, is_clause, origin + done as char_start,
              case when is_clause then origin + done + cut else ends end as char_end,
              page_start, page_end, number,
              case when n = 0 then heading else concat(heading, ' (cont.)') end as heading, section_path,
              left(rest, cut) as text, joint
            from {name}_cut""",
    }


def _list_state(source: str, outline: str) -> str:
    """B7 state over a table of lines; `outline` is a boolean expression."""
    so_far = "over (partition by doc_id order by line_no rows unbounded preceding)"
    group = "over (partition by doc_id, _anchor order by line_no rows {})"
    before = group.format("between unbounded preceding and 1 preceding")
    return f"""
      select *, coalesce(min(_ok) {group.format('unbounded preceding')}, 1) as _ok_so_far,
        coalesce(min(_ok) {before}, 1) as _ok_before
      from (
        select *, case when _digits then cast(coalesce(_item = 1 or _item = coalesce(
            last_value(_item ignore nulls) {before}, -1) + 1, false) as int) end as _ok
        from (
          select *, sum(cast(_is_anchor as int)) {so_far} as _anchor,
            last_value(case when _is_anchor then case when is_section or _outline or term is not null then '' else number end end ignore nulls) {so_far} as _anchor_number,
            case when _digits then cast(number as bigint) end as _item
          from (
            select *, is_start and regexp_matches(number, '^\\d+$') and not _outline as _digits,
              is_section or _outline or term is not null or (is_start and not regexp_matches(number, '^\\d+$')) as _is_anchor
            from (select *, {outline} as _outline from {source}))))"""


_NUM = "read_text"
_NUMBER = f"""case when is_section then null
  when {matches(_NUM, fixed.RE_PAREN)} then {extract(_NUM, fixed.RE_PAREN_MARK, 1)}
  when {matches(_NUM, fixed.RE_LABELLED)} then regexp_replace({extract(_NUM, fixed.RE_LABELLED)}, '\\s+', ' ', 'g')
  when {matches(_NUM, fixed.RE_CODED_ITEM)} then printf('Excl%02d', cast({extract(_NUM, fixed.RE_CODED_ITEM, 1)} as int))
  when {matches(_NUM, fixed.RE_BARE_INT)} or {matches(_NUM, fixed.RE_DECIMAL_MONEY)} then null
  when {matches(_NUM, fixed.RE_DECIMAL)} then {extract(_NUM, fixed.RE_DECIMAL, 1)} end"""
_STRONG = f"""({matches(_NUM, fixed.RE_PAREN)} or {matches(_NUM, fixed.RE_LABELLED)} or {matches(_NUM, fixed.RE_CODED_ITEM)}
  or {matches(_NUM, fixed.RE_DECIMAL_STRONG)})"""

_OUT_NAME = (
    f"array_to_string(list_filter(regexp_split_to_array(lower({extract('read_text', fixed.RE_OUTLINE, 2)}), '\\s+'), "
    f"lambda w: w not in {q_list(fixed.OUTLINE_FILLER)} and w <> ''), ' ')"
)

CTES: dict[str, str] = {
    "v_documents": f"""
      select doc_id, source, array_to_string(list_transform(
        list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''),
        lambda x, i: {shapes.decorate('x', '(i - 1)', 'doc_id', 'chr(10)', 'chr(12)')}), chr(10)) as text
      from documents""",
    "v_split": r"""
      select doc_id, page, text, cast(row_number() over (partition by doc_id order by page, li) - 1 as int) as line_no
      from (
        select doc_id, page, li, trim(regexp_replace(raw, '[\x00-\x1f]', ' ', 'g')) as text
        from (
          select doc_id, page, unnest(string_split(p, chr(10))) as raw,
            generate_subscripts(string_split(p, chr(10)), 1) as li
          from (
            select doc_id, unnest(string_split(text, chr(12))) as p,
              cast(generate_subscripts(string_split(text, chr(12)), 1) - 1 as int) as page
            from v_documents)))
      where text <> ''""",
    "v_offsets": """
      select *, char_start + length(text) as char_end from (
        select *, cast(coalesce(sum(length(text) + 1) over (partition by doc_id order by line_no
          rows between unbounded preceding and 1 preceding), 0) as bigint) as char_start
        from v_split)""",
    "v_lines": f"select *, {_style()} from v_offsets",
    "v_body": """
      select doc_id, arg_max(body_size, {'w': weight, 'f': -first_line}) as body_size, max(weight) as weight from (
        select doc_id, round(size, 1) as body_size, cast(sum(length(text)) as bigint) as weight, min(line_no) as first_line
        from v_lines group by all) group by doc_id""",
    "v_read": f"""
      select * exclude (mate), coalesce({matches('text', fixed.RE_MARKER_ONLY)} and mate.page = page
          and abs(mate.y0 - y0) < (y1 - y0) / 2 and mate.x0 > x0, false) as joined,
        case when joined then concat(text, ' ', mate.text) else text end as read_text,
        case when joined then mate.bold else words_bold end as read_words_bold
      from (
        select l.*, b.body_size, lead({{'text': text, 'page': page, 'x0': x0, 'y0': y0, 'bold': bold}})
          over (partition by doc_id order by line_no) as mate
        from v_lines l join v_body b using (doc_id))""",
    "v_class": f"""
      select *, avg(case when numbering is not null then cast(bold as int) end) over (partition by doc_id) as share,
        coalesce(share >= {fixed.BOLD_NUMBER_SHARE}, false) as numbers_bold,
        case when not is_section and bold and {matches('read_text', fixed.RE_DEFINED_TERM)}
          then {extract('read_text', fixed.RE_DEFINED_TERM, 1)} end as term,
        coalesce(numbering is not null and term is null
          and (strong or read_words_bold or size >= body_size * {fixed.CLAUSE_SIZE_RATIO})
          and not (numbers_bold and not bold and {matches('numbering', fixed.RE_SINGLE_LEVEL)}), false) as is_start,
        regexp_replace(numbering, '\\.+$', '') as number
      from (
        select *, {_NUMBER} as numbering, {_STRONG} as strong, case when is_section then head end as section_title
        from (
          select *, {despaced('trim(text)')} as head,
            ((size >= body_size * {fixed.SECTION_SIZE_RATIO} and bold)
             or (bold and {matches('trim(text)', fixed.RE_ANNEXURE_HEAD)})
             or (length(head) <= {fixed.SECTION_MAX_CHARS}
                 and regexp_matches(head, '\\p{{Lu}}') and not regexp_matches(head, '\\p{{Ll}}')
                 and ({matches('head', fixed.RE_SECTION_HEAD)} or {matches('lower(head)', fixed.RE_SECTION_WORD)}))) as is_section
          from v_read))""",
    "v_shaped": f"""
      select *, case when not is_section and {matches('read_text', fixed.RE_OUTLINE)}
        and {matches(_OUT_NAME, fixed.RE_OUTLINE_NAME)} then {extract('read_text', fixed.RE_OUTLINE, 1)} end as label
      from v_class""",
    "v_state1": _list_state("v_shaped", "coalesce(regexp_matches(label, '^[a-h]$'), false)"),
    "v_outline": """
      select *, coalesce(lag(is_outline and joined) over (partition by doc_id order by line_no), false) as is_spent from (
        select * exclude (_outline, _digits, _is_anchor, _anchor, _anchor_number, _item, _ok, _ok_so_far, _ok_before),
          _outline or (eligible = 1 and coalesce(sum(eligible) over (partition by doc_id, _anchor order by line_no
            rows between unbounded preceding and 1 preceding), 0) = 0) as is_outline
        from (
          select *, cast(coalesce(regexp_matches(label, '^\\d'), false)
            and coalesce(starts_with(_anchor_number, concat(try_cast(label as int) - 1, '.')), false) and _ok_before = 1
            and (coalesce(starts_with(lead(read_text, 1) over w, concat(label, '.1')), false)
              or coalesce(starts_with(lead(read_text, 2) over w, concat(label, '.1')), false)
              or coalesce(starts_with(lead(read_text, 3) over w, concat(label, '.1')), false)) as int) as eligible
          from v_state1 window w as (partition by doc_id order by line_no)))""",
    "v_clean": """
      select * replace (
        is_section and not is_spent as is_section,
        is_outline and not is_spent as is_outline,
        case when not is_spent then section_title end as section_title,
        case when not is_spent and not is_outline then term end as term,
        is_start and not is_spent and not is_outline as is_start)
      from v_outline""",
    "v_state2": _list_state("v_clean", "is_outline"),
    "v_started": f"""
      select doc_id, line_no, page, text, char_start, char_end, accepted as is_start, is_break,
        coalesce(last_value(title ignore nulls) over so_far, '') as section_path,
        cast(sum(cast(accepted or is_break as int)) over so_far as bigint) as island,
        is_break or is_spent as is_heading_line,
        case when accepted and term is null then number else '' end as number,
        case when term is not null then term
          when accepted and length(read_text) <= {fixed.HEADING_MAX_CHARS} then trim(read_text) else '' end as heading
      from (
        select *, (is_start and not (_digits and contains(coalesce(_anchor_number, ''), '.') and _ok_so_far = 1))
            or term is not null as accepted,
          is_section or is_outline as is_break,
          coalesce(section_title, case when is_outline then read_text end) as title
        from v_state2)
      window so_far as (partition by doc_id order by line_no rows unbounded preceding)""",
    "v_islands": """
      select doc_id, not is_heading_line as is_clause, min(char_start) as char_start, max(char_end) as char_end,
        min(page) as page_start, max(page) as page_end, arg_min(number, line_no) as number,
        arg_min(heading, line_no) as heading, arg_min(section_path, line_no) as section_path,
        string_agg(text, chr(10) order by line_no) as text, chr(10) as joint
      from v_started group by doc_id, island, is_heading_line""",
    **_pieces("v_islands", "v_pieces"),
    "v_grouped": f"""
      select *, sum(cast(is_clause and not lead_in as int)) over (partition by doc_id order by char_start desc
          rows unbounded preceding) as grp
      from (
        select *, is_clause and number = '' and {matches('text', fixed.RE_LEAD_IN)}
          and char_start < max(case when is_clause then char_start end) over (partition by doc_id) as lead_in
        from v_pieces)""",
    "v_merged": """
      select doc_id, true as is_clause, min(char_start) as char_start, max(char_end) as char_end,
        min(page_start) as page_start, max(page_end) as page_end,
        arg_max(number, char_start) filter (is_clause) as number,
        arg_max(heading, char_start) filter (is_clause) as heading,
        arg_max(section_path, char_start) filter (is_clause) as section_path,
        string_agg(case when char_start = first_start then text else concat(joint, text) end, '' order by char_start, is_clause) as text,
        arg_min(joint, char_start) filter (is_clause) as joint
      from (
        select *, min(case when is_clause then char_start end) over (partition by doc_id, grp) as first_start
        from v_grouped)
      where char_start >= first_start group by doc_id, grp""",
    **_pieces("v_merged", "v_resplit"),
    "v_clauses": f"""
      select doc_id, cast(row_number() over w - 1 as int) as order_idx, section_path, number, heading, text, page_start,
        page_end, char_start, char_end,
        coalesce({matches('number', fixed.RE_TOP_NUMBER)} and not ends_with(heading, '(cont.)')
          and not {matches('text', fixed.RE_QUANTITY)}
          and (lead(number) over w = concat(number, '.1') or regexp_matches(lead(text) over w, {q(fixed.RE_FIRST_ITEM)})),
          false) as is_heading
      from v_resplit window w as (partition by doc_id order by char_start)""",
    "v_margins": rf"""
      select *, case when y0 < page_height * {fixed.MARGIN_BAND}::double then 'top'
          when y1 > page_height * (1 - {fixed.MARGIN_BAND}::double) then 'bottom'
          when regexp_matches(trim(text), '^\d+$') then 'number' end as band,
        case when y0 < page_height * {fixed.MARGIN_BAND}::double or y1 > page_height * (1 - {fixed.MARGIN_BAND}::double)
          then regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\d+', '#', 'g')
          when regexp_matches(trim(text), '^\d+$') then printf('%.2f', y0 / page_height) end as margin_key
      from (
        select doc_id, page, line_no, text, line_no * 10.0::double as y0, line_no * 10.0::double + 8 as y1,
          count(*) over (partition by page) * 10.0::double as page_height
        from (
          select page_id as page, regexp_extract(url, '^https?://([^/?#]+)', 1) as doc_id, text,
            row_number() over (partition by page_id order by block_no) - 1 as line_no
          from v_html_lines))""",
    # Tags of lines become marks; what stands between two marks is a line.
    "v_html_lines": rf"""
      select page_id, url, block_no, inside, case when name = '' or name[1] = '/' or name in ('br', 'hr') then 'text' else name end as tag, text
      from (
        select *, trim(regexp_replace({unescape("regexp_replace(inside, " + q(ln.RE_TAG) + ", ' ', 'g')")}, '[\x00-\x20]+', ' ', 'g')) as text
        from (
          select page_id, url, block_no, case when block_no = 0 then '' else lower(split_part(piece, chr(2), 1)) end as name,
            case when block_no = 0 then piece else split_part(piece, chr(2), 2) end as inside
          from (
            select page_id, url, unnest(pieces) as piece, generate_subscripts(pieces, 1) - 1 as block_no
            from (
              select page_id, url, string_split(regexp_replace(regexp_replace(html, {q(ln.RE_DROPPED)}, '', 'g'),
                {q("(?is)<(/?(?:" + ln.BLOCKS + "))" + chr(92) + "b" + ln.RE_ATTRIBUTES + ">")}, chr(1) || '\1' || chr(2), 'g'), chr(1)) as pieces
              from pages))))
      where text <> ''""",
    "v_repeated": f"""
      select doc_id, band, margin_key, count(distinct page) as n_pages, any_value(doc_pages) as doc_pages
      from v_margins join (select doc_id, count(distinct page) as doc_pages from v_margins group by doc_id) using (doc_id)
      where band is not null group by doc_id, band, margin_key
      having n_pages >= greatest({fixed.MARGIN_MIN_PAGES}, {fixed.MARGIN_PAGE_SHARE} * any_value(doc_pages))""",
    "v_analysed": "select *, "
    + ", ".join(f"{sql} as {name}" for name, sql in shapes.ANALYSIS.items())
    + " from v_clauses",
    "v_ids": """
      select *, case when rep = 1 then base else concat(base, '#', rep) end as clause_id from (
        select *, row_number() over (partition by doc_id, base order by order_idx) as rep from (
          select *, case when number <> '' then number else concat('c', order_idx) end as base from v_analysed
          where clause_type is not null))""",
    "v_terms": f"""
      select distinct doc_id, term from (
        select doc_id, lower(h) as term from (
          select doc_id, trim(case when number <> '' then substring(heading, length(number) + 1) else heading end, ' .-') as h
          from v_analysed where clause_type = 'definition' and heading <> '')
        where length(h) > 2 and length(h) < 60
        union all
        select doc_id, lower(trim({extract('trim(text)', fixed.RE_TERM_MEANS, 1)}, ' .-0123456789')) as term
        from v_analysed where clause_type = 'definition')
      where term <> ''""",
    "v_used": """
      select c.doc_id, c.order_idx, count(t.term) as terms_used
      from v_analysed c left join v_terms t on t.doc_id = c.doc_id and contains(lower(c.text), t.term)
      group by all""",
    "v_signals": f"""
      select * exclude (grade), grade, least(greatest((grade - 8.0::double) / 12.0::double, 0.0::double), 1.0::double) as reading,
        least(crossrefs / 4.0::double, 1.0::double) as crossref, least(terms_used / 3.0::double, 1.0::double) as jargon
      from (
        select *, case when words > 0 then greatest(0.39::double * (words / units) + 11.8::double * (syllables / words) - 15.59::double, 0.0::double)
          else 0.0::double end as grade
        from (
          select a.*, u.terms_used, percent_rank() over (partition by a.doc_id order by a.order_idx) as position,
            {count(plain('text'), fixed.RE_CROSSREF)} as crossrefs,
            {readable('text')} as readable, {count('readable', fixed.RE_WORD)} as words,
            greatest(case when regexp_matches(readable, '[.!?]')
              then len(list_filter(regexp_split_to_array(readable, '[.!?]+'), lambda s: regexp_matches(s, '\\S')))
              else len(list_filter(string_split(readable, chr(10)), lambda s: regexp_matches(s, '\\S'))) end, 1) as units,
            {count('readable', '(?i)[aeiouy]+')}
              - len(list_filter(regexp_extract_all(readable, {q(fixed.RE_WORD)}), lambda w: regexp_matches(w, {q(tx.RE_SILENT_E)})))
              + len(list_filter(regexp_extract_all(readable, {q(fixed.RE_WORD)}), lambda w: regexp_matches(w, {q(tx.RE_NO_VOWEL)}))) as syllables
          from v_analysed a join v_used u using (doc_id, order_idx)))""",
    "v_scored": f"""
      select * replace (round(position, 6) as position, round(reading, 6) as reading, round(crossref, 6) as crossref,
          round(jargon, 6) as jargon, round(grade, 6) as grade, round(buriedness, 6) as buriedness),
        round(100.0::double * weight * (0.5::double * ((likelihood - 1) / 4) + 0.5::double * ((severity - 1) / 4))
          * (1 + {fixed.BURIED_BOOST}::double * buriedness) / (1 + {fixed.BURIED_BOOST}::double), 6) as impact
      from (
        select *, {fixed.W_POSITION}::double * position + {fixed.W_READING}::double * reading
          + {fixed.W_CROSSREF}::double * crossref + {fixed.W_JARGON}::double * jargon as buriedness,
          cast(coalesce({case_of('clause_type', fixed.TYPE_WEIGHT)}, {fixed.OTHER_TYPE_WEIGHT}) as double) as weight
        from v_signals where clause_type is not null)""",
}


def compose(final: str) -> str:
    """The query with every shared table it needs, each after those it reads."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\bv_\w+", sql):
            if name in CTES and name not in needed and name not in open_names:
                open_names.add(name)
                visit(CTES[name])
                needed.append(name)

    open_names: set[str] = set()
    visit(final)
    if not needed:
        return final
    body = ",\n".join(f"{n} as ({CTES[n]})" for n in needed)
    own = re.match(r"\s*with\s+(?!recursive)", final)
    if own:
        return f"with recursive {body},\n{final[own.end():]}"
    return f"with recursive {body}\n{final}"
