"""Queries of the remaining operators: scalars, schema kinds, prompts, files and providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.operators import model_stage as M
from sheaf.operators import parsing as P
from sheaf.operators import prompts
from sheaf.operators import rendering as R
from sheaf.operators import validation as V
from sheaf.plans import duck as D
from sheaf.plans.corpora import HEADING_COLUMNS, MESSAGE_COLUMNS, literal, quoted, resumes, values_sql, with_table, with_table_sql
from sheaf.plans.parsing_queries import HEADINGS
from sheaf.plans.record_queries import MESSAGES
from sheaf.sources import files, sinks
from sheaf.sources.staging import stage_folder

col = F.col


def prs3_normalize_heading(spark, sf_dir):
    return with_table(spark, sf_dir, HEADINGS, "id long, line string", "part", HEADING_COLUMNS).select("id", T.normalize_heading(col("line")).alias("normalized"))


def prs5_date_pattern(spark, sf_dir):
    """What comes before the first date range of every line that has one."""
    return P.lines(resumes(spark, sf_dir)).select("doc_id", "pos", T.date_before(col("line")).alias("before")).where("before is not null")


def prs11_lone_date(spark, sf_dir):
    return P.lines(resumes(spark, sf_dir)).where(T.lone_date(col("line"))).select("doc_id", "pos")


def evd4_employment_items(spark, sf_dir):
    """Items of all employment sections of a document, in order, out of the nested record."""
    items = F.flatten(F.transform(F.filter("sections", lambda s: s["type"] == "employment"), lambda s: s["items"]))
    return P.semantic(resumes(spark, sf_dir)).select("doc_id", F.posexplode(items).alias("pos", "i")).select("doc_id", "pos", "i.heading", F.size("i.bullets").alias("n_bullets"))


def _messages(spark, sf_dir):
    return with_table(spark, sf_dir, MESSAGES, "id long, m string", "conversations", MESSAGE_COLUMNS)


def jsn5_repair_messages(spark, sf_dir):
    m = prompts.repair_messages("job requirements", col("m"), F.lit("bad shape"))
    return _messages(spark, sf_dir).select("id", F.substring_index(F.get(m, F.lit(1))["content"], "Error:\n", -1).alias("tail"))


#: Label, shape of the answer, values of the literal rows, and a value for each event: SQL that both engines read.
_KINDS = {
    "val1_text": ("semantic CV", '{"header":[],"sections":[{"type":%s,"heading":"h"}]}', ['" a "', '""', "null", "3", '"x"'], """case event_id % 4 when 0 then '"  ' || event_type || ' "' when 1 then '"  "' when 2 then props else cast(user_id as string) end"""),
    "val4_numbers": ("CV profile", '{"summary":"s","yearsOfExperience":%s,"education":[{"graduationYear":%s}]}', ["0", "2.5", "-1", '"3"', "2020", "true"], """case when event_id % 7 = 0 then '"' || user_id || '"' else case when event_id % 5 = 0 then '-' else '' end || case event_id % 3 when 0 then cast(user_id as string) when 1 then cast(cast(value as decimal(18, 2)) as string) else user_id || '.0' end end"""),
    "val5_boolean": ("output review", '{"passed":%s}', ["true", "false", '"true"', "1", "null"], """case event_id % 4 when 0 then 'true' when 1 then 'false' when 2 then '"' || event_type || '"' else props end"""),
    "val6_object_arrays": ("CV profile", '{"summary":"s","projects":%s}', ["[]", '[{"name":"n","description":"d"}]', '[{"name":"n"}]', "{}", "null", '[{"name":"n","description":"d"},1]'], """case event_id % 6 when 0 then '[]' when 1 then '[{"name":" ' || event_type || '","description":"d"},{"name":"n","description":"' || user_id || '"}]' when 2 then '[{"name":"' || event_type || '"}]' when 3 then props when 4 then '[' || props || ']' else '[{"name":" ","description":"' || event_type || '"}]' end"""),
}


def _kind_query(name: str):
    label, shape, values, of_event = _KINDS[name]

    def query(spark, sf_dir):
        rows = literal(spark, [(i, shape.replace("%s", v)) for i, v in enumerate(values)], "id long, answer string")
        events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id + 100 as id", f"replace({quoted(shape)}, '%s', {of_event}) as answer")
        return rows.unionByName(events).select("id", V.validate(F.array("answer"), label)["error"].isNull().alias("valid"))

    query.__name__ = name
    return query


#: For each schema a record around one text, and where that text is in it.
_RECORDS = {
    "CV profile": ('{"summary":%s}', "$.summary"),
    "job requirements": ('{"roleTitle":%s,"keywords":["k"]}', "$.roleTitle"),
    "match analysis": ('{"matchScore":1,"summary":"s","suggestedPositioning":%s}', "$.suggestedPositioning"),
    "application assets": ('{"cvImprovements":{"improvedBullets":[" ",%s]},"linkedinMessage":"l","coverLetter":"c","interviewPrep":{}}', "$.cvImprovements.improvedBullets[0]"),
    "output review": ('{"passed":true,"issues":[%s]}', "$.issues[0]"),
    "preferences": ('{"linkedinTone":%s}', "$.linkedinTone"),
    "semantic CV": ('{"sections":[{"type":"t","heading":%s}]}', "$.sections[0].heading"),
    "raw analysis": ('{"provider":"p","generatedAt":"g","cvProfile":{"summary":%s},"jobRequirements":{"roleTitle":"r"},"matchAnalysis":{"matchScore":1,"summary":"s","suggestedPositioning":"p"},"applicationAssets":{"cvImprovements":{},"linkedinMessage":"l","coverLetter":"c","interviewPrep":{}}}', "$.cvProfile.summary"),
}


def val7_all_schemas(spark, sf_dir):
    """For every schema, records around a padded text of a row, checked, typed and printed again: the text comes back trimmed, and a blank one is refused or left out."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("t", F.when(col("n_nationkey") % 5 == 0, '"  "').otherwise(F.concat(F.lit('" '), "n_name", F.lit(' "'))))
    out = None
    for label, (shape, path) in _RECORDS.items():
        v = V.validate(F.array(F.replace(F.lit(shape), F.lit("%s"), col("t"))), label)
        one = rows.select("n_nationkey", F.lit(label).alias("label"), v.alias("v")).select("n_nationkey", "label", col("v.error").isNull().alias("valid"), F.get_json_object(F.to_json(V.typed(col("v.data"), label)), path).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def val8_whole_run(spark, sf_dir):
    from sheaf.plans.workflow_queries import home_runs

    runs = home_runs(spark, sf_dir).runs.select("doc_id", "job_id", F.to_json("run").alias("j"))
    return runs.select("doc_id", "job_id", V.validate(F.array("j"), "raw analysis")["error"].isNull().alias("valid"))


def llm1_provider_names(spark, sf_dir):
    """Names in any case of letters; others are refused, and none is the local one."""
    asked = F.when(col("n_nationkey") % 4 == 0, "Ollama").when(col("n_nationkey") % 4 == 1, "OPENAI").when(col("n_nationkey") % 4 == 2, col("n_name"))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", asked.alias("asked")).withColumn("chosen", M.provider_name(col("asked")))


def pmt_prompts(spark, sf_dir):
    """All five prompts end with the inputs of their row."""
    a, b, c, d, e = (F.concat(F.lit(f'{{"{k}":'), col("n_nationkey").cast("string"), F.lit("}")) for k in "pjmaw")
    made = {"profile": prompts.profile_messages(a), "job": prompts.job_messages(a), "match": prompts.match_messages(a, b), "assets": prompts.asset_messages(a, b, c, e), "review": prompts.review_messages(a, b, c, d, e)}
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = n.select("n_nationkey", F.explode(F.array(*[F.struct(F.lit(k).alias("prompt"), m.alias("m")) for k, m in made.items()])).alias("x"))
    return rows.select("n_nationkey", "x.prompt", F.size("x.m").alias("n"), F.substring_index(F.get("x.m", F.lit(1))["content"], ":\n", -1).alias("last"))


def rnd3_location(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    job = F.when(col("c_custkey") % 2 == 0, col("c_mktsegment"))
    return c.select("c_custkey", R.location_summary(job, F.when(col("c_custkey") % 3 == 0, col("c_name"))).alias("summary"))


def rnd4_improvements(spark, sf_dir):
    one, none = F.array(col("n_name")), F.array().cast("array<string>")
    x = F.struct(one.alias("improvedBullets"), none.alias("skillsToEmphasize"), F.array(F.lit("a"), F.lit("b")).alias("experienceToRewrite"), none.alias("missingKeywords"))
    y = F.struct(none.alias("likelyInterviewTopics"), one.alias("technicalQuestions"), none.alias("behavioralQuestions"), none.alias("suggestedTalkingPoints"))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", R.cv_improvements(x).alias("improvements"), R.interview_prep(y).alias("prep"))


def rnd9_closing(spark, sf_dir):
    return _messages(spark, sf_dir).select("id", T.has_closing(col("m")).alias("closed"))


def rnd12_timestamp(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.date_format("ts", "yyyy-MM-dd_HH-mm-ss").alias("stamp"))


def src1_text_files(spark, sf_dir):
    """Texts written as files and read again, whole, with their line ends."""
    folder = stage_folder(spark, "texts")
    text = F.concat(col("m"), F.lit("\r\nend")).alias("content")
    rows = with_table(spark, sf_dir, MESSAGES, "id long, m string", "benchmark", ["item_id + 100 as id", "text as m"]).select(F.lit("in").alias("run_dir"), F.concat(col("id").cast("string"), F.lit(".txt")).alias("file_name"), text)
    sinks.write_files(rows, folder).count()
    return files.read_text(spark, f"{folder}/in").select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("id"), "text")


def snk3_saved_profiles(spark, sf_dir):
    """Profiles saved, loaded, and checked as they are loaded."""
    folder = f"{stage_folder(spark, 'profiles')}/context"
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named = F.concat(F.lit(" "), F.substring("text", 1, 20), F.lit(" "))
    data = lambda name: F.to_json(F.struct(name.alias("name"), F.when(col("item_id") % 5 > 0, col("text")).alias("summary")))
    sinks.save_profiles(b.select(col("item_id").alias("doc_id"), data(named).alias("data")), folder)
    # Saved again, by key: every third has another name.
    sinks.upsert_profiles(b.select(col("item_id").alias("doc_id"), data(F.when(col("item_id") % 3 == 0, F.lit("new")).otherwise(named)).alias("data")), folder)
    out = files.load_profiles(spark, folder)
    return out.select(F.regexp_extract("path", r"profile-(\d+)\.json$", 1).cast("long").alias("doc_id"), F.get_json_object("data", "$.name").alias("name"), col("error").isNull().alias("valid"))


def _benchmark_files(spark, sf_dir) -> str:
    """A folder with one file for each benchmark text; the odd ones are named as PDFs, in capitals."""
    folder = stage_folder(spark, "benchmark")
    name = F.concat(col("item_id").cast("string"), F.when(col("item_id") % 2 == 0, ".txt").otherwise(".PDF"))
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.lit("in").alias("run_dir"), name.alias("file_name"), F.concat("text", F.lit("\r\nend")).alias("content"))
    sinks.write_files(rows, folder).count()
    return f"{folder}/in"


def _item():
    return F.regexp_extract("path", r"(\d+)\.(?:txt|PDF)$", 1).cast("long").alias("item_id")


def src2_binary_files(spark, sf_dir):
    """Bytes of files, by their digest."""
    return files.read_binary(spark, _benchmark_files(spark, sf_dir)).select(_item(), F.length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


def src3_documents_by_extension(spark, sf_dir):
    """Text files as they are, others through the PDF reader that is given; what it gives is trimmed, and nothing is an error."""
    out = files.read_documents(spark, _benchmark_files(spark, sf_dir), pdf_reader=lambda content: "" if content[:1] in b"aeiou" else f" page: {content.decode()} ")
    return out.select(_item(), "text", F.substring_index("error", ' "', 1).alias("problem"))


def src6_exists_deleted(spark, sf_dir):
    """Whether a folder is there before and after it is deleted, and what deleting says, the second time, too."""
    folder = _benchmark_files(spark, sf_dir)
    said = [files.exists(spark, folder), sinks.delete_if_exists(spark, folder), files.exists(spark, folder), sinks.delete_if_exists(spark, folder)]
    return literal(spark, list(enumerate(said)), "step int, said boolean")


def src9_resolved_paths(spark, sf_dir):
    path = F.when(col("n_nationkey") % 4 == 0, F.concat(F.lit("/a/"), "n_name")).when(col("n_nationkey") % 4 == 1, F.concat(F.lit("s3://bucket/"), "n_name")).when(col("n_nationkey") % 4 == 2, F.concat(F.lit("file:///"), "n_name")).otherwise(col("n_name"))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(path.alias("path"))
    full = files.resolved(col("path"))
    return rows.select("path", (full == col("path")).alias("same"), full.endswith(col("path")).alias("ends"))




def snk6_pretty_json(spark, sf_dir):
    """A JSON file as it is written, line by line, and a text file of the same content, which stays as it is."""
    folder = stage_folder(spark, "json")
    content = F.concat(F.lit('{"b":[1,{"é":null}],"a":{},"c":[],"d":'), F.to_json(F.array("text")), F.lit("}")).alias("content")
    name = lambda kind: F.concat(col("item_id").cast("string"), F.lit(f".{kind}")).alias("file_name")
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    sinks.write_files(b.select(F.lit("r").alias("run_dir"), F.explode(F.array(name("json"), name("txt"))).alias("file_name"), content), folder).count()
    at = F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("item_id")
    return files.read_text(spark, f"{folder}/r").select(at, F.regexp_extract("path", r"\.(\w+)$", 1).alias("kind"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def rul6_has_text(spark, sf_dir):
    """Of every document, and of its first line."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.has_text(col("text")).alias("whole"), T.has_text(F.substring("text", 1, 1)).alias("opens"))


_OWN = (src2_binary_files, src3_documents_by_extension, src6_exists_deleted, src9_resolved_paths, snk6_pretty_json, rul6_has_text, prs3_normalize_heading, prs5_date_pattern, prs11_lone_date, evd4_employment_items, jsn5_repair_messages, val7_all_schemas, val8_whole_run, llm1_provider_names, pmt_prompts, rnd3_location, rnd4_improvements, rnd9_closing, rnd12_timestamp, src1_text_files, snk3_saved_profiles)
QUERIES = {f.__name__: f for f in (*_OWN, *map(_kind_query, _KINDS))}

_P = D.parse_ctes()
_NL = "chr(10)"
_MSG = with_table_sql(MESSAGES, ["id", "m"], "conversations", MESSAGE_COLUMNS)


def _doc(title: str, parts: list[tuple[str, str]]) -> str:
    return f"'# {title}'" + "".join(f" || {_NL} || {_NL} || '## {h}' || {_NL} || {_NL} || {x}" for h, x in parts) + f" || {_NL}"


_NONE, _ONE = "'- None identified'", "'- ' || n_name"
_LONE = f"(regexp_matches(line, '{D.DATE}', 'i') or regexp_matches(line, '^(?:[A-Za-z]+{D.WS}+)?[0-9]{{4}}$'))"
_FILLED = lambda g, k: f"coalesce(json_type({g}, '{k}') = 'VARCHAR' and trim(({g}->>'{k}')) <> '', false)"
#: What the value of an answer must be, by the JSON functions of DuckDB.
_VALID = {
    "val1_text": _FILLED("j", "$.sections[0].type"),
    "val4_numbers": "case when json_type(j, '$.yearsOfExperience') in ('UBIGINT', 'BIGINT', 'DOUBLE') then (j->>'$.yearsOfExperience')::double >= 0 and (j->>'$.yearsOfExperience')::double = floor((j->>'$.yearsOfExperience')::double) else false end",
    "val5_boolean": "json_type(j, '$.passed') = 'BOOLEAN'",
    "val6_object_arrays": f"case when json_type(j, '$.projects') = 'ARRAY' then len(list_filter((j->'$.projects')::json[], lambda g: not (json_type(g) = 'OBJECT' and {_FILLED('g', '$.name')} and {_FILLED('g', '$.description')}))) = 0 else false end",
}


def _kind_sql(name: str) -> str:
    _, shape, values, of_event = _KINDS[name]
    rows = f"select id::bigint id, v from ({values_sql(list(enumerate(values)), ['id', 'v'])}) union all select event_id + 100, {of_event} from events"
    return f"select id, {_VALID[name]} valid from (select id, replace({quoted(shape)}, '%s', v)::json j from ({rows}))"


_QUOTED = "to_json(text)::varchar"
_PRETTY_LINES = [quoted(x) for x in ('{', '  "b": [', '    1,', '    {', '      "é": null', '    }', '  ],', '  "a": {},', '  "c": [],', '  "d": [')] + [f"'    ' || {_QUOTED}", quoted("  ]"), quoted("}"), "''"]
_PRETTY_SQL = f"""select item_id, 'json' kind, (generate_subscripts(l, 1) - 1)::int pos, unnest(l) line from (select item_id, [{', '.join(_PRETTY_LINES)}] l from benchmark)
 union all select item_id, 'txt', 0, '{{"b":[1,{{"é":null}}],"a":{{}},"c":[],"d":[' || {_QUOTED} || ']}}' from benchmark"""
_LAST = {"profile": "p", "match": "j", "assets": "w", "review": "w"}
ORACLES = {
    "prs3_normalize_heading": f"select id, {D.normalize_heading('line')} normalized from ({with_table_sql(HEADINGS, ['id', 'line'], 'part', HEADING_COLUMNS)})",
    "prs5_date_pattern": _P + f"select doc_id, pos, regexp_extract(line, '^([\\s\\S]*?)(?:{D.DATE})', 1, 'i') as before from lines where regexp_matches(line, '{D.DATE}', 'i')",
    "prs11_lone_date": _P + f"select doc_id, pos from lines where {_LONE}",
    "evd4_employment_items": _P + f", it as ({D.ITEMS}), bu as (select doc_id, section_id, item_id, count(*) n from ({D.BULLETS}) group by 1, 2, 3) select doc_id, (row_number() over (partition by doc_id order by section_id, item_id) - 1)::int pos, heading, coalesce(n, 0)::int n_bullets from it left join bu using (doc_id, section_id, item_id)",
    "jsn5_repair_messages": f"select id, 'bad shape' || {_NL} || {_NL} || 'Answer:' || {_NL} || m tail from ({_MSG})",
    "val7_all_schemas": f"select n_nationkey, label, not (blank and required) valid, case when not blank then n_name end as text from (select n_nationkey, n_name, n_nationkey % 5 = 0 blank from nation) cross join ({values_sql([(x, x not in ('application assets', 'output review', 'preferences')) for x in _RECORDS], ['label', 'required'])})",
    "val8_whole_run": "select doc_id, c_nationkey job_id, true valid from (select o_custkey doc_id from orders group by 1 having count(*) >= 3) join customer on c_custkey = doc_id",
    "llm1_provider_names": "select n_nationkey, case n_nationkey % 4 when 0 then 'Ollama' when 1 then 'OPENAI' when 2 then n_name end asked, case n_nationkey % 4 when 0 then 'ollama' when 1 then 'openai' when 3 then 'ollama' end chosen from nation",
    "pmt_prompts": "select n_nationkey, prompt, 2::int n, case when k = '' then '{\"p\":' else '{\"' || k || '\":' end || n_nationkey || '}' as last from nation cross join (values ('profile', 'p'), ('job', 'p'), ('match', 'j'), ('assets', 'w'), ('review', 'w')) v(prompt, k)",
    "rnd3_location": f"select c_custkey, 'Job: ' || case when c_custkey % 2 = 0 then c_mktsegment else 'Not specified' end || {_NL} || 'Candidate: ' || case when c_custkey % 3 = 0 then c_name else 'Not specified' end summary from customer",
    "rnd4_improvements": f"select n_nationkey, {_doc('CV Improvements', [('Suggested Improved CV Bullets', _ONE), ('Skills To Emphasize', _NONE), ('Experience That Should Be Rewritten', f'''{quoted('- a')} || {_NL} || {quoted('- b')}'''), ('Missing Keywords From The Job Description', _NONE)])} improvements, {_doc('Interview Prep', [('Likely Interview Topics', _NONE), ('Technical Questions', _ONE), ('Behavioral Questions', _NONE), ('Suggested Talking Points', _NONE)])} prep from nation",
    "rnd9_closing": f"select id, {D.closing('m')} closed from ({_MSG})",
    "rnd12_timestamp": "select event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') stamp from events",
    "src2_binary_files": f"select item_id, octet_length(encode(t))::bigint n_bytes, md5(t) digest from (select item_id, text || chr(13) || {_NL} || 'end' t from benchmark)",
    "src3_documents_by_extension": f"select item_id, case when item_id % 2 = 0 then t when not v then 'page: ' || t end as text, case when item_id % 2 = 1 and v then 'No text could be extracted from' end problem from (select item_id, text || chr(13) || {_NL} || 'end' t, contains('aeiou', left(text, 1)) v from benchmark)",
    "src6_exists_deleted": "select * from (values (0, true), (1, true), (2, false), (3, false)) v(step, said)",
    "src9_resolved_paths": "select case n_nationkey % 4 when 0 then '/a/' when 1 then 's3://bucket/' when 2 then 'file:///' else '' end || n_name path, n_nationkey % 4 < 3 same, true ends from nation",
    "snk6_pretty_json": _PRETTY_SQL,
    "rul6_has_text": f"select doc_id, coalesce(length({D.trim('text')}) > 0, false) whole, coalesce(length({D.trim('left(text, 1)')}) > 0, false) opens from documents",
    "src1_text_files": f"select id, m || chr(13) || {_NL} || 'end' as text from ({with_table_sql(MESSAGES, ['id', 'm'], 'benchmark', ['item_id + 100', 'text'])})",
    "snk3_saved_profiles": f"select item_id doc_id, case when item_id % 5 > 0 then case when item_id % 3 = 0 then 'new' else {D.trim('left(text, 20)')} end end as name, item_id % 5 > 0 valid from benchmark",
    **{n: _kind_sql(n) for n in _KINDS},
}
