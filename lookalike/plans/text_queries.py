"""Queries of texts (I), streams (J) and plug-ins (K) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lookalike.functions.rng import uniform_sql
from lookalike.operators import gate as K
from lookalike.operators import plugins as U
from lookalike.operators import profile as P
from lookalike.operators import repair as R
from lookalike.operators import text as X
from lookalike.plans.model_queries import SEMANTICS_SQL
from lookalike.plans.registry import query
from lookalike.plans.util import t, union_all
from lookalike.streaming import incremental as J


def _aba_sql(x: str) -> str:
    return "(" + " + ".join(f"{(3, 7, 1)[i % 3]} * substr({x}, {i + 1}, 1)::int" for i in range(9)) + ") % 10 = 0"


def _counts_sql(text: str) -> tuple[str, list[str]]:
    """Nested replacements, kind by kind, as the operator does; the gated kind is the last."""
    cols, now = [], text
    for p in X.PII:
        pat = p.pattern.replace("'", "''")
        found = f"regexp_extract_all({now}, '{pat}')"
        cols.append(f"len(list_filter({found}, lambda x: {_aba_sql('x')}))" if p.gated else f"len({found})")
        now = f"regexp_replace({now}, '{pat}', '{X.MARK}', 'g')"
    return now, cols


_, _CNT = _counts_sql("text")


@query("i01_pii_counts", "select doc_id, " + ", ".join(f"{c}::int as {p.kind.lower()}" for c, p in zip(_CNT, X.PII, strict=True)) + " from documents")
def i01(s, d):
    return X.pii_counts(t(s, d, "documents"), "text", "doc_id")


_ROWS = "(" + "\nunion all\n".join(f"select doc_id, '{p.kind}' as kind, {c} as n, lang, source from documents" for c, p in zip(_CNT, X.PII, strict=True)) + ")"


@query("i01_detect_pii", f"select doc_id, kind, sum(n)::bigint as findings from {_ROWS} where n > 0 group by all")
def i01d(s, d):
    found = X.detect_pii(t(s, d, "documents"), "text", "doc_id")
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("findings"))


@query("i02_pii_summary", f"select lang, source, kind, count(*) as documents, sum(n)::bigint as findings from {_ROWS} where n > 0 group by all")
def i02(s, d):
    return X.pii_summary(t(s, d, "documents"), "text", "doc_id", ["lang", "source"])


@query("i03_pii_policy", f"select kind, case when kind in ('EMAIL', 'SSN', 'IP', 'PHONE') then 'redact' else 'flag' end as action, sum(n)::bigint as findings from {_ROWS} where n > 0 and kind in ('EMAIL', 'SSN', 'IP', 'PHONE', 'URL', 'STREET') group by all")
def i03(s, d):
    found = X.pii_policy(X.detect_pii(t(s, d, "documents"), "text", "doc_id")).where(F.col("kind").isin("EMAIL", "SSN", "IP", "PHONE", "URL", "STREET"))
    return found.groupBy("kind", "action").agg(F.count("*").alias("findings"))


def _redact_sql(c: str) -> str:
    for p in X.PII:
        pat = p.pattern.replace("'", "''")
        if p.gated:
            parts, hits = f"string_split_regex({c}, '{pat}')", f"regexp_extract_all({c}, '{pat}')"
            c = f"array_to_string(list_transform(list_zip({parts}, {hits}), lambda z: z[1] || coalesce(case when {_aba_sql('z[2]')} then '[REDACTED_{p.kind}]' else z[2] end, '')), '')"
        else:
            c = f"regexp_replace({c}, '{pat}', '[REDACTED_{p.kind}]', 'g')"
    c = f"regexp_replace({c}, '(?i)(ending in|last four|last 4)( digits)?:? [0-9]{{4}}', '\\1 [REDACTED_CARD]', 'g')"
    return f"regexp_replace({c}, '(?i)(my name is) [A-Za-z][A-Za-z''-]*( [A-Z][A-Za-z''-]*)?', '\\1 [REDACTED_NAME]', 'g')"


_SAID = "(select conv_id, turn, case when turn = 0 then 'my name is Ada Lovelace, mail a.b@c.org, card ending in 4242, routing 021000021, order 123456789, call (555) 123-4567. ' else '' end || text as text from conversations)"


@query("i04_redact", f"select conv_id, turn, md5({_redact_sql('text')}) as digest from {_SAID}")
def i04(s, d):
    c = t(s, d, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") == 0, "my name is Ada Lovelace, mail a.b@c.org, card ending in 4242, routing 021000021, order 123456789, call (555) 123-4567. ").otherwise(""), "text").alias("text"))
    return c.select("conv_id", "turn", F.md5(X.redact(F.col("text"))).alias("digest"))


_ENT = "(select o_orderkey, 'Order of ' || strftime(o_orderdate, '%Y-%m-%d') || ' by Dr. Ada Lovelace for Acme Tools Inc' as text from orders)"


@query("i05_extract_entities", f"select o_orderkey, 'date' as label, unnest(list_distinct(regexp_extract_all(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))) as entity from {_ENT} union all select o_orderkey, 'organisation', 'Acme Tools Inc' from {_ENT} union all select o_orderkey, 'person', 'Dr. Ada Lovelace' from {_ENT}")
def i05(s, d):
    o = t(s, d, "orders").select("o_orderkey", F.concat(F.lit("Order of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" by Dr. Ada Lovelace for Acme Tools Inc")).alias("text"))
    return X.extract_entities(o, "text", "o_orderkey")


@query(
    "i06_text_stats",
    r"with x as (select doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> '') as w from documents) select doc_id, length(text)::int as chars, len(w)::int as words, len(regexp_extract_all(text, '[.!?]+([ \t\n\r]|$)'))::int as sentences, (len(regexp_extract_all(text, '\n')) + 1)::int as lines, len(list_distinct(list_transform(w, lambda z: lower(z))))::int as distinct_words, round(length(text)::double / len(w), 6) as chars_per_word, round(len(list_distinct(list_transform(w, lambda z: lower(z))))::double / len(w), 6) as distinct_ratio from x",
)
def i06(s, d):
    return X.text_stats(t(s, d, "documents"), "text", "doc_id")


_NORM = r"trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g'))"


@query("i07_duplicate_docs", f"with h as (select doc_id, min(doc_id) over (partition by {_NORM}) as f from documents) select doc_id, case when f < doc_id then f end as duplicate_of from h")
def i07(s, d):
    return X.duplicate_docs(t(s, d, "documents"), "text", "doc_id")


#: Texts of orders, with phrases of document types by the number of the order.
_PHRASES = ["Invoice number 7, total due $12.50, bill to us", "This agreement and the terms and conditions, hereby signed", "Dear sir, kind regards", "Executive summary. Introduction. Findings", "Curriculum vitae: education, skills", "Dear customer, invoice", "nothing to see", "Abstract, whereas, sincerely"]
_DOCS08 = f"(select o_orderkey, o_orderstatus || ' ' || list_extract({_PHRASES!r}, (o_orderkey % {len(_PHRASES)} + 1)::int) || case when o_custkey % 3 = 0 then ' £5' else '' end as text from orders union all select -doc_id - 1, text from documents)"
_SIGNS = ", ".join([f"case when contains(lower(text), '{w}') then struct_pack(kind := '{k}', said := '{k}:{w.strip()}') end" for k, ws in X.TYPES.items() for w in ws] + [f"case when regexp_matches(text, '{X.MONEY}') then struct_pack(kind := 'invoice', said := 'invoice:amount') end"])
_SHARES = ", ".join(f"struct_pack(less := -len(list_filter(f, lambda x: x.kind = '{k}')), kind := '{k}')" for k in sorted(X.TYPES))


@query(
    "i08_classify_docs",
    f"""with f as (select o_orderkey, list_filter([{_SIGNS}], lambda x: x is not null) as f from {_DOCS08}),
r as (select *, list_filter(list_sort([{_SHARES}]), lambda x: x.less < 0) as r from f),
s as (select *, list_transform(r, lambda x: round(-x.less::double / len(f), 6)) as s from r)
select o_orderkey, coalesce(r[1].kind, 'other') as doc_type, coalesce(s[1], 0.0) as confidence,
case when coalesce(s[1], 0.0) < 0.5 or coalesce(s[1], 0.0) - coalesce(s[2], 0.0) < 0.15 then 'REVIEW_REQUIRED' else 'proposed' end as status,
array_to_string(list_transform(f, lambda x: x.said), ',') as evidence,
array_to_string(list_transform(list_zip(r[2:4], s[2:4]), lambda x: x[1].kind || ' ' || x[2]::varchar), ',') as alternatives from s""",
)
def i08(s, d):
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("o_orderkey") % len(_PHRASES) + 1).cast("int"))
    said = t(s, d, "orders").select("o_orderkey", F.concat("o_orderstatus", F.lit(" "), phrase, F.when(F.col("o_custkey") % 3 == 0, " £5").otherwise("")).alias("text"))
    return X.classify_docs(said.unionByName(t(s, d, "documents").select((-F.col("doc_id") - 1).alias("o_orderkey"), "text")), "text", "o_orderkey")


_N09 = r"n as (select doc_id, lang, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r\f\x0B]+', ' ', 'g')), '') as c from documents)"
_G09 = "g as (select doc_id, lang, unnest(list_transform(range(1, len(c) - 1), lambda k: c[k] || c[k + 1] || c[k + 2])) as gram from n where len(c) > 2)"
_P09 = "p as (select lang, gram, round(ln(n / t), 6) as weight from (select *, sum(n) over (partition by lang) as t, row_number() over (partition by lang order by n desc, gram) as i from (select lang, gram, count(*) as n from g where lang is not null group by all)) where i <= 300)"
_S09 = "s as (select doc_id, lang, round(sum(n * coalesce(weight, -12.0)) / sum(n), 6) as s from (select doc_id, gram, count(*) as n from g group by all) d cross join (select distinct lang from p) l left join p using (lang, gram) group by all)"


@query("i09_language_profiles", f"with {_N09}, {_G09}, {_P09} select * from p")
def i09p(s, d):
    return X.language_profiles(t(s, d, "documents"), "text", "lang")


@query("i09_detect_language", f"with {_N09}, {_G09}, {_P09}, {_S09}, a as (select n.doc_id, len(if(c = [''], [], c)) as chars, l.lang, coalesce(s.s, -12.0) as s from n cross join (select distinct lang from p) l left join s on s.doc_id = n.doc_id and s.lang = l.lang), b as (select *, max(s) over (partition by doc_id) as m from a), r as (select doc_id, chars, min(lang) filter (where s = m) as language, 1 / sum(exp((s - m) * 4)) as sure from b group by all) select doc_id, language, round(sure, 4) as confidence, case when chars < 20 or sure < 0.6 then 'review' else 'ok' end as status from r")
def i09(s, d):
    docs = t(s, d, "documents")
    return X.detect_language(docs, "text", "doc_id", X.language_profiles(docs, "text", "lang"))


@query("i10_shape", "select c_custkey, translate(regexp_replace(regexp_replace(regexp_replace(c_name, '[0-9]', chr(1), 'g'), '[A-Z]', chr(2), 'g'), '[a-z]', 'l', 'g'), chr(1) || chr(2), 'NU') as shape, 'text' as class from customer")
def i10(s, d):
    return t(s, d, "customer").select("c_custkey", X.shape(F.col("c_name")).alias("shape"), X.value_class(F.col("c_name")).alias("class"))


_FU = lambda i: f"(('0x' || substr(md5(concat_ws('|', '42', 'fill', cast({i} as varchar), cast(c_custkey as varchar))), 1, 13))::bigint / 4503599627370496.0)"


@query("i11_fill_shape", "select c_custkey, array_to_string(list_transform(range(length(c_name)), lambda i: case when regexp_matches(c_name[i + 1], '[0-9]') then cast(floor(" + _FU("i") + " * 10)::int as varchar) when regexp_matches(c_name[i + 1], '[A-Z]') then chr(65 + floor(" + _FU("i") + " * 26)::int) when regexp_matches(c_name[i + 1], '[a-z]') then chr(97 + floor(" + _FU("i") + " * 26)::int) else c_name[i + 1] end), '') as filled from customer")
def i11(s, d):
    return t(s, d, "customer").select("c_custkey", X.fill_shape(X.shape(F.col("c_name")), "fill", "c_custkey").alias("filled"))


_FIELDS = "(select o_orderkey, list_extract(['Total', 'Order date', 'Customer name', 'Order number', 'Remark'], (o_orderkey % 5 + 1)::int) as label, list_extract([printf('$%.2f', o_totalprice), strftime(o_orderdate, '%Y-%m-%d'), 'Customer of ' || o_orderstatus, o_custkey::varchar, '-12,5'], (o_custkey % 5 + 1)::int) as value from orders)"
_CLASS12 = r"case when regexp_matches(value, '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})$') then 'date' when regexp_matches(value, '^[$€£] ?[0-9][0-9,]*(\.[0-9]+)?$') then 'currency' when regexp_matches(value, '^-?[0-9][0-9,]*(\.[0-9]+)?$') then 'numeric' else 'text' end"
_FITS12 = {"amount": "('numeric', 'currency')", "date": "('date')", "party": "('text')", "identifier": "('numeric', 'text')"}
_ROLE12 = ", ".join(f"struct_pack(score := (case when regexp_matches(lower(label), '{'|'.join(ws)}') then 3 else 0 end + case when class in {_FITS12[r]} then 2 else 0 end)::int, role := '{r}')" for r, ws in X.ROLES_BY_LABEL.items())


@query("i12_field_semantics", f"with c as (select *, {_CLASS12} as class from {_FIELDS}), b as (select o_orderkey, list_sort([{_ROLE12}])[-1] as b from c) select o_orderkey, case when b.score >= 3 then b.role else 'other' end as role, b.score as score from b")
def i12(s, d):
    o = t(s, d, "orders")
    pick = lambda by, *xs: F.element_at(F.array(*xs), (F.col(by) % 5 + 1).cast("int"))
    label = pick("o_orderkey", *[F.lit(x) for x in ("Total", "Order date", "Customer name", "Order number", "Remark")])
    value = pick("o_custkey", F.format_string("$%.2f", "o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("Customer of "), "o_orderstatus"), F.col("o_custkey").cast("string"), F.lit("-12,5"))
    return X.field_semantics(o.select("o_orderkey", label.alias("label"), value.alias("value")), "label", "value", "o_orderkey")


@query("i13_extract_fields", "select o_orderkey, -floor(o_totalprice)::double as total, cast(o_orderdate as date) as day, o_orderstatus = 'F' as paid, 'Customer ' || o_custkey as buyer from orders")
def i13(s, d):
    o = t(s, d, "orders")
    body = F.concat_ws("\n", F.concat(F.lit("Buyer: Customer "), F.col("o_custkey").cast("string"), F.lit(" [1]")), F.format_string("Total: (%,d)", F.floor("o_totalprice")), F.concat(F.lit("  day : "), F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(F.col("o_orderstatus") == "F", "Paid: yes").otherwise("Paid: No"))
    return X.extract_fields(o.select("o_orderkey", body.alias("body")), "body", "o_orderkey", {"total": "number", "day": "date", "paid": "boolean", "buyer": "text"})


_TURNS = r"(select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as turn, case when role in ('assistant', 'system') then 'agent' else 'customer' end as speaker, regexp_replace(text, '\s+', ' ', 'g') as said from conversations)"


def _turns(s, d):
    return X.parse_turns(X.transcripts(t(s, d, "conversations")), "transcript", "conv_id")


@query("i14_parse_turns", f"select * from {_TURNS}")
def i14(s, d):
    return _turns(s, d)


def _list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


@query("i15_synth_turns", f"select conv_id, turn, speaker, case when speaker = 'agent' then ({_list(X.AGENT)})[turn % 5 + 1] else ({_list(X.CUSTOMER)})[turn % 5 + 1] end as said from {_TURNS}")
def i15(s, d):
    return X.synth_turns(_turns(s, d))


@query("i16_validate_turns", "select conv_id, true as same_turns, 0::bigint as copied, 0::bigint as residual_pii from conversations group by conv_id")
def i16(s, d):
    src = _turns(s, d)
    return X.validate_turns(src, X.synth_turns(src), "conv_id")


@query("i17_text_safety", f"select doc_id, concat_ws(',', case when length(text) < 1 then 'too_short' end, case when length(text) > 500 then 'too_long' end, case when regexp_matches(text, '{X.PII[0].pattern}') then 'email' end, case when regexp_matches(text, '{X.PII[1].pattern.replace(chr(39), chr(39) * 2)}') then 'url' end, case when regexp_matches(text, '[0-9]{{6,}}') then 'long_number' end, case when regexp_matches(text, '(?i)(password|ssn|token|secret)') then 'sensitive_word' end, case when regexp_matches(text, '[A-Z]{{2,}}-[0-9]{{3,}}') then 'identifier' end, case when contains(lower(text), 'worthless') then 'forbidden:worthless' end) as reasons from documents")
def i17(s, d):
    return X.text_safety(t(s, d, "documents"), "text", "doc_id", ["worthless"])


@query("i17_source_replay", f"select doc_id from documents where doc_id % 2 = 1 and {_NORM} in (select {_NORM} from documents where doc_id % 2 = 0)")
def i17r(s, d):
    docs = t(s, d, "documents")
    return X.source_replay(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), "text", "doc_id")


_TIDY = r"trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))"


@query("i18_sanitize_text", f"select doc_id, md5(case when length({_TIDY}) <= 500 then {_TIDY} else regexp_replace(substr({_TIDY}, 1, 501), ' [^ ]*$', '') end) as digest from documents")
def i18(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(X.sanitize_text(F.col("text"))).alias("digest"))


def _eligible_sql(c: str) -> str:
    heavy = f"regexp_matches('{c}', 'description|comment|note|bio|summary|text') or coalesce(avg(length({c})) >= 40 or (avg(length({c})) >= 20 and count(distinct {c})::double / count(*) >= 0.8), false)"
    personal = " or ".join([*(f"regexp_matches('{c}', '{p}')" for p in P.PII_NAMES.values()), *(f"coalesce(count(*) filter (where regexp_matches({c}, '{p}')) >= 0.8 * nullif(count({c}), 0), false)" for p in P.PII_VALUES.values())])
    return f"select '{c}' as column_name, ({heavy}) and not regexp_matches('{c}', '(^|_)(id|uuid|guid)$|key$') and not ({personal}) as eligible from documents"


@query("i19_text_eligibility", "\nunion all\n".join(map(_eligible_sql, ["text", "lang", "source"])))
def i19(s, d):
    docs = t(s, d, "documents")
    j = P.is_text_heavy(docs).join(P.pii_semantic(docs), "column_name").join(P.is_identifier(docs), "column_name")
    return X.text_eligibility(j)


@query("i20_check_rendered", "select o_orderkey, 2::bigint as fields, case when o_orderkey % 3 = 0 then 'status' else '' end as missing from orders")
def i20(s, d):
    o = t(s, d, "orders")
    want = o.select("o_orderkey", F.explode(F.array(F.struct(F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("status").alias("field"), F.concat(F.lit("state "), "o_orderstatus").alias("value")))).alias("f")).select("o_orderkey", "f.*")
    text = o.select("o_orderkey", F.concat(F.upper("o_orderpriority"), F.lit("\n\n"), F.when(F.col("o_orderkey") % 3 == 0, "?").otherwise(F.concat(F.lit("state   "), "o_orderstatus"))).alias("text"))
    return X.check_rendered(want, text, "o_orderkey")


# --- J

_COLS = ["user_id", "value"]
_PROF = union_all("select '{c}' as column_name, count(*) as row_count, count(*) - count({c}) as null_count, min({c})::double as minimum, max({c})::double as maximum, round(sum({c})::double / count({c}), 4) as mean from events", _COLS)


@query("j01_profile_stream", _PROF)
def j01(s, d):
    return J.profile_stream(J.stream(s, f"{d}/events.parquet"), _COLS).drop("distinct_estimate")


@query("j02_infer_stream", SEMANTICS_SQL)
def j02(s, d):
    return J.infer_stream(J.stream(s, f"{d}/orders.parquet"), ["o_orderkey"])


@query("j03_validate_stream", "select 'negative' as issue, count(*) filter (where value < 0) as n from events union all select 'orphan', count(*) filter (where user_id not in (select c_custkey from customer where c_custkey % 2 = 0)) from events")
def j03(s, d):
    parents = t(s, d, "customer").where("c_custkey % 2 = 0")
    return J.validate_stream(J.stream(s, f"{d}/events.parquet"), parents, "user_id", "c_custkey", {"negative": F.col("value") < 0})


@query("j03_windowed_sums", "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2 having date_trunc('day', ts)::timestamp + interval 1 day <= (select max(ts) - interval 2 days from events)")
def j03w(s, d):
    sdf = J.stream(s, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.windowed_sums(sdf, "ts", "value", "event_type")


@query("j04_reservoir_stream", f"select event_id, {uniform_sql('reservoir', 'event_id')} as priority from events order by 2, 1 limit 200")
def j04(s, d):
    return J.reservoir_stream(J.stream(s, f"{d}/events.parquet"), 200, ["event_id"], ["event_id"])


_RULE = R.PercentRule("event_type", "=", "click", 30.0, ("other",))


@query("j05_apply_rule_chunks", "select count(*) as n, floor(0.3::double * count(*) + 0.5)::bigint as hits from events")
def j05(s, d):
    return J.apply_rule_chunks(t(s, d, "events"), F.weekofyear("ts"), _RULE, "event_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("hits"))


_DAYS = "select date_trunc('hour', ts) as chunk, count(*) as n, sum(count(*)) over (order by date_trunc('hour', ts)) as upto from events group by 1"


@query("j05_rule_targets", f"select chunk, n, floor(30.0::double * upto / 100 + 0.5)::bigint - floor(30.0::double * (upto - n) / 100 + 0.5)::bigint as want from ({_DAYS})")
def j05_targets(s, d):
    return J.rule_targets(t(s, d, "events"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), 30.0)


@query("j05_rows_of_chunks", f"select chunk, n, floor(30.0::double * upto / 100 + 0.5)::bigint - floor(30.0::double * (upto - n) / 100 + 0.5)::bigint as hits from ({_DAYS})")
def j05_rows(s, d):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    done = J.apply_rule_chunks(t(s, d, "events"), hour, _RULE, "event_id")
    return done.groupBy(hour.alias("chunk")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("hits"))


@query("j06_aggregate_evidence", "with e as (select count(*) filter (where event_type = 'click') as h, count(*) as n from events) select 'event_type = click' as rule, 30.0::double as target, round(h * 100.0::double / n, 4) as actual, h = floor(n * 30.0::double / 100 + 0.5) or abs(round(h * 100.0::double / n, 4) - 30) <= 0.25 as passed from e")
def j06(s, d):
    return J.aggregate_evidence(J.chunk_evidence(t(s, d, "events"), F.to_date("ts"), [_RULE]), [_RULE])


@query("j08_clean_stream", "select 'props' as column_name, count(*) as row_count, count(*) - count(props) as null_count, count(*) filter (where props is not null and try_cast(trim(props) as double) is null) as failed from events")
def j08(s, d):
    return J.clean_stream(J.stream(s, f"{d}/events.parquet"), "props")


# --- K


@U.register_generator("double_price", "double")
def _double(frame):
    return frame["o_totalprice"] * 2


@query("k01_generator", "select o_orderkey, o_totalprice * 2 as twice from orders")
def k01(s, d):
    return U.generate_with(t(s, d, "orders"), "twice", "double_price", ["o_orderkey", "o_totalprice"]).select("o_orderkey", "twice")


@query("k02_post_process", "select c_custkey, reverse(c_mktsegment) as c_mktsegment from customer")
def k02(s, d):
    return U.post_process(t(s, d, "customer"), "c_mktsegment", lambda v: v[::-1], "string").select("c_custkey", "c_mktsegment")


@K.register_metric("row_ratio")
def _row_ratio(source, synthetic):
    n = synthetic["orders"].agg(F.count("*").alias("a")).crossJoin(source["orders"].agg(F.count("*").alias("b")))  # one row each
    return K.check(n, "row_ratio", "shape", F.round(F.col("a") / F.col("b"), 6), F.col("a") >= 0.4 * F.col("b"), table="orders", threshold=0.4)


@query("k03_metric", f"select 'row_ratio' as name, round(count(*) filter (where {uniform_sql('split', 'o_orderkey')} < 0.5)::double / count(*), 6) as metric, 'PASS' as status from orders")
def k03(s, d):
    from lookalike.plans.util import halves

    o = t(s, d, "orders")
    return K.run_metrics({"orders": o}, {"orders": halves(o, "o_orderkey")[0]}, ["row_ratio"]).select("name", "metric", "status")


@query("k04_synthesizer")
def k04(s, d):
    syn, path = U.synthesizer("copula"), J.shared(s, "model")
    li = t(s, d, "lineitem").select("l_quantity", "l_discount")
    U.save_model(s, syn.fit(li), path)
    return syn.sample(s, U.load_model(s, path), li.count())


@query("k05_constraint", "select 0::bigint as violations from (select count(*) from lineitem)")
def k05(s, d):
    c = U.constraint("range", column="l_quantity", lo=5.0, hi=40.0)
    return c.validate(c.apply(t(s, d, "lineitem")))
