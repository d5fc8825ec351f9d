"""DuckDB counterparts of the operator queries, written from their definitions."""

from __future__ import annotations

from .chat import PART_TURNS
from .langid import FOLDS, HELD_OUT, LONGEST, PROFILE, UNKNOWN
from .lines import SHORT
from .quality import RULES, STOP_WORDS
from .search import DECIMALS, K1, TOP, B
from .sharding import SHARD_BYTES
from .substrings import WINDOW

SPACES = r"[\x20\x09-\x0D]+"


def _lines() -> str:
    """Pairs meet on an equal half; one edit is checked position by position."""
    return f"""
    with l as (select doc_id, i - 1 as p, l[i] as line, regexp_matches(l[i], '[^\x20\x09-\x0D]') as word
               from (select doc_id, l, unnest(generate_series(1, len(l))) as i
                     from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))),
    f as (select line, len(line) as n, min((doc_id, p)) as pos from l where word group by line),
    h as (select line, n, pos, g, 0 as side, substr(line, 1, g // 2) as half from f, unnest([n, n + 1]) u(g) where n >= {SHORT}
          union all
          select line, n, pos, g, 1, substr(line, n - (g - 1 - g // 2) + 1) from f, unnest([n, n + 1]) u(g) where n >= {SHORT}),
    pair as (select distinct a.pos as pos, a.line as x, b.line as y from h a join h b
             on a.g = b.g and a.side = b.side and a.half = b.half and greatest(a.n, b.n) = a.g and b.pos < a.pos),
    gone as (select distinct pos from pair where case when len(x) = len(y)
               then len(list_filter(generate_series(1, len(x)), lambda i: x[i] <> y[i])) = 1
               when len(x) < len(y) then len(list_filter(generate_series(1, len(y)), lambda i: substr(y, 1, i - 1) || substr(y, i + 1) = x)) > 0
               else len(list_filter(generate_series(1, len(x)), lambda i: substr(x, 1, i - 1) || substr(x, i + 1) = y)) > 0 end),
    kept as (select pos from f where pos not in (select pos from gone)),
    m as (select l.*, not word or k.pos is not null as stay from l left join kept k on k.pos = (l.doc_id, l.p))
    select doc_id, count(*) filter (word) as n_lines, count(*) filter (not stay) as n_removed,
           sha256(coalesce(string_agg(line, chr(10) order by p) filter (stay), '')) as kept_sha256
    from m group by doc_id"""


def sharding_sql(limit: int = SHARD_BYTES) -> str:
    return f"""
    with sized as (
      select row_number() over () as rid, doc_id, strlen(coalesce(text, '')) as n_bytes,
             substr(md5(coalesce(doc_id::varchar, '')), 1, 12) as h from documents),
    hashed as (
      select rid, doc_id, n_bytes,
             array_to_string(list_transform(string_split(h, ''),
               lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') as bits from sized),
    marks as (select rid, doc_id, n_bytes, d as depth, substr(bits, 1, d) as shard
              from hashed, range(0, 33) r(d)),
    buckets as (select shard, depth, sum(n_bytes) as shard_bytes, count(*) as shard_rows
                from marks group by all having sum(n_bytes) <= {limit} or count(*) = 1)
    select doc_id, n_bytes, shard, depth::int as depth, shard_bytes::bigint as shard_bytes, shard_rows
    from (select m.*, b.shard_bytes, b.shard_rows, row_number() over (partition by rid order by m.depth) as k
          from marks m join buckets b using (shard, depth)) where k = 1"""


def _substrings() -> str:
    return f"""
    with w as (select row_number() over () as rid, doc_id,
                 list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') as w from documents),
    g as (select rid, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as gram
          from (select rid, doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) as i from w)),
    f as (select gram, min(doc_id) as first from g group by gram),
    hit as (select rid, i from g join f using (gram) where first < doc_id),
    gone as (select distinct rid, i + k as i from hit, range(0, {WINDOW}) r(k)),
    words as (select rid, i, w[i] as word from (select rid, w, unnest(generate_series(1, len(w))) as i from w)),
    kept as (select words.rid, count(*) as n, string_agg(word, ' ' order by i) as kept_text
             from words anti join gone on words.rid = gone.rid and words.i = gone.i group by words.rid)
    select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept_text, '')) as kept_sha256
    from w left join kept using (rid)"""


def _quality() -> str:
    checks = []
    for rule in RULES:
        a, _, b = rule.figure.partition(" / ")
        x = f"({a}::double / nullif({b}, 0))" if b else a
        tests = [f"{x} < {rule.least}"] * (rule.least is not None) + [f"{x} > {rule.most}"] * (rule.most is not None)
        checks.append(f"case when {' or '.join(tests)} then '{rule.name}' end")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
    with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
    w as (select *, list_filter(regexp_split_to_array(text, '{SPACES}'), lambda x: x <> '') as w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from t),
    f as (select rid, doc_id, len(w) as n_words, len(array_to_string(w, '')) as word_chars,
                 len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
                 len(text) - len(replace(text, '!', '')) as n_exclamations,
                 len(text) - len(regexp_replace(text, '\\p{{Lu}}', '', 'g')) as n_capitals,
                 len(regexp_replace(text, '\\P{{L}}+', '', 'g')) as n_letters,
                 len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
                 len(list_filter(w, lambda x: lower(x) in ({stop}))) as n_stop_words from w),
    tri as (select rid, i, w[i] as a, w[i + 1] as b, w[i + 2] as c
            from (select rid, w, unnest(generate_series(1, len(w) - 2)) as i from w)),
    twice as (select rid, i from tri qualify count(*) over (partition by rid, a, b, c) > 1),
    cover as (select rid, least(3, coalesce(lead(i) over (partition by rid order by i) - i, 3)) as n from twice),
    rep as (select rid, sum(n) as n from cover group by rid),
    g as (select f.*, coalesce(rep.n, 0)::bigint as n_repeat_words from f left join rep using (rid)),
    v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
                 list_filter([{', '.join(checks)}], lambda x: x is not null) as failed from g)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and len(failed) = 0 as kept, array_to_string(failed, ',') as failed_rules from v"""


def _search() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '{SPACES}'),
                 lambda x: x <> '') as w from documents),
    s as (select count(*) as n, avg(len(w)) as mean from w),
    p as (select doc_id, len as dl, term, count(*) as tf from (select doc_id, len(w) as len, unnest(w) as term from w) group by all),
    d as (select term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf from p, s group by term, n),
    q as (select doc_id as query_id, term, tf as times from p where doc_id % 50 = 0),
    r as (select query_id, p.doc_id, round(sum(times * idf * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / mean))), {DECIMALS}) as score
          from q join p using (term) join d using (term), s where p.doc_id <> query_id group by all)
    select query_id, doc_id, score, rank from (
      select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from r) where rank <= {TOP}"""


def _chat() -> str:
    return f"""
    with r as (select distinct conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text
               from conversations),
    p as (select *, coalesce(turn // {PART_TURNS}, -1) as part from r),
    c as (select distinct conv_id, speaker as perspective from r where speaker <> 'system'),
    s as (select p.*, perspective, speaker = perspective as mine, text || '<|end|>' || chr(10) as tail,
                 case when speaker = 'system' then '<|system|>' when speaker = perspective then '<|assistant|>'
                      else '<|user name=' || speaker || '|>' end || chr(10) as head
          from p join c on p.conv_id is not distinct from c.conv_id),
    o as (select *, sum(len(head) + len(tail)) over (partition by conv_id, perspective, part
                    order by turn nulls first, speaker, text rows unbounded preceding) as stop from s)
    select conv_id, perspective, part, count(*) as n_turns,
           string_agg(head || tail, '' order by turn nulls first, speaker, text) as rendered,
           coalesce(string_agg((stop - len(tail))::varchar || ':' || stop::varchar, ',' order by stop) filter (mine), '') as loss_spans,
           coalesce(sum(len(tail)) filter (mine), 0)::bigint as n_loss_chars
    from o group by conv_id, perspective, part"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _divergence() -> str:
    return f"""
    with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
                 regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as t from documents),
    o as (select lang, source, term, count(*) as n, count(distinct rid) as docs
          from (select rid, lang, source, unnest(t) as term from d) group by all),
    k as (select lang, term, sum(n) as n from o group by all having sum(docs) >= 10),
    l as (select lang, sum(n) + 2 * count(*) as total from k group by lang),
    g as (select distinct lang, source from d),
    c as (select g.lang, g.source, k.term, coalesce(o.n, 0) as n, k.n as lang_n
          from g join k using (lang) left join o using (lang, source, term)),
    m as (select lang, source, sum(n) + 2 * count(*) as total from c group by all),
    p as (select c.*, 1 + (1000000000::hugeint * (c.n + 2)::hugeint) // m.total::hugeint as p,
                 1 + (1000000000::hugeint * (lang_n + 2)::hugeint) // l.total::hugeint as q
          from c join m using (lang, source) join l using (lang)),
    pair as (select a.lang, a.source, b.source as item,
                    coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) as value
             from g a join g b on a.lang = b.lang and a.source <> b.source
             left join p x on x.lang = a.lang and x.source = a.source
             left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
    both_parts as (select lang, source, 'pair' as part, item, value from pair
             union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from p where n > 0 and p > q)
    select lang, source, part, item, value::bigint as value, rank::int as rank from (
      select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from both_parts)
    where part = 'pair' or rank <= 10"""


#: CRC-32 of a list of bytes, by a table of 256 entries that is worked out from the polynomial.
_CRC_TABLE = """(select list(v order by i) as tab from (select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as v from range(256) r(i)))"""


def _crc32(octets: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _octets(text: str) -> str:
    return f"""flatten(list_transform(string_split({text}, ''), lambda ch: case when unicode(ch) < 128 then [unicode(ch)::bigint]
        else [(192 + (unicode(ch) >> 6))::bigint, (128 + (unicode(ch) & 63))::bigint] end))"""


def _spelling() -> str:
    return f"""
    with r as (select doc_id, run, count(*) as n from (
            select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) as run
            from documents) group by all),
    h as (select run, n, {_crc32(_octets("coalesce(doc_id::varchar, '') || ':' || run"))} as h from r, {_CRC_TABLE} where length(run) >= 5),
    s as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from h),
    w as (select word, sum(n)::bigint as n from s where length(word) >= 5 group by word having sum(n) >= 3),
    cut as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
            from (select word, n, unnest(generate_series(1, length(word))) as i from w)),
    pair as (select distinct a.word as word, b.word as near, b.n as near_n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
             union select a.word, b.word, b.n from cut a join w b on a.rest = b.word
             union select a.word, b.word, b.n from w a join cut b on b.rest = a.word),
    best as (select word, count(*) as n_near, min((-near_n, near)) as best from pair group by word),
    f as (select w.word, w.n, coalesce(n_near, 0) as n_near,
                 case when -best[1] >= 2 * w.n then best[2] end as form, case when -best[1] >= 2 * w.n then -best[1] end as form_n
          from w left join best using (word)),
    chain as (with recursive step as (select word, form as last from f where form is not null
              union all select step.word, f.form from step join f on f.word = step.last where f.form is not null)
              select step.word, last as root from step join f on f.word = step.last where f.form is null)
    select word, form, coalesce(root, word) as root, n, n_near, form_n from f left join chain using (word)"""


def _language() -> str:
    sizes = ", ".join(str(k) for k in range(2, LONGEST + 1))
    return f"""
    with d as (select row_number() over () as rid, doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') as w,
                 {_crc32(_octets("coalesce(doc_id::varchar, '')"))} % {FOLDS} = {HELD_OUT} as held_out from documents, {_CRC_TABLE}),
    v as (select rid, word, count(*) as n from (select rid, unnest(w) as word from d) group by all),
    k as (select word, unnest(flatten([string_split(word, '')] || list_transform([{sizes}], lambda k: list_transform(
                 generate_series(1, length(word) + 3 - k), lambda i: substr('_' || word || '_', i, k))))) as gram
          from (select distinct word from v)),
    c as (select rid, gram, sum(n)::bigint as n from v join k using (word) group by all),
    mine as (select rid, gram, place from (select rid, gram, row_number() over (partition by rid order by n desc, gram) - 1 as place from c) where place < {PROFILE}),
    learned as (select lang, gram, sum(n) as n from c join d using (rid) where not held_out and lang is not null group by all),
    profile as (select lang, gram, place from (select lang, gram, row_number() over (partition by lang order by n desc, gram) - 1 as place from learned) where place < {PROFILE}),
    size as (select rid, count(*) as m from mine group by rid),
    hit as (select rid, lang, sum({PROFILE} - abs(mine.place - profile.place)) as nearer from mine join profile using (gram) group by all),
    away as (select size.rid, m, l.lang, {PROFILE} * m - coalesce(nearer, 0) as distance
             from size cross join (select distinct lang from profile) l left join hit on hit.rid = size.rid and hit.lang = l.lang),
    best as (select rid, min((distance, lang)) as best, any_value(m) as m from away group by rid)
    select doc_id, held_out, coalesce(best[2], '{UNKNOWN}') as lang_pred, coalesce(1 - best[1]::double / ({PROFILE} * m)::double, 0.0) as score
    from d left join best using (rid)"""


ORACLES: dict[str, str] = {
    "op1_deletion_line_dedup": _lines(),
    "op5_extendible_shards": sharding_sql(),
    "op7_fm_index_substrings": _substrings(),
    "op8_quality_rules": _quality(),
    "op9_block_max_search": _search(),
    "op10_perspective_rotation": _chat(),
    "op11_cube_source_divergence": _divergence(),
    "op12_partenum_spelling_variants": _spelling(),
    "op13_rank_order_language": _language(),
}
