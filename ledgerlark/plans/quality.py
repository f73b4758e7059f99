"""Registered data-quality, import and search queries and their oracles."""

from pyspark.sql import functions as F

from ledgerlark.operators import quality as Q
from ledgerlark.operators import search as S
from ledgerlark.operators.names import NameIndex
from ledgerlark.plans.registry import query, written_once
from ledgerlark.plans.stem_sql import ranks
from ledgerlark.sources import io


@query("quality_drop_orphans", "SELECT id, campaign_id FROM tasks t WHERE EXISTS (SELECT 1 FROM campaigns c WHERE c.id = t.campaign_id AND c.organization_id = t.organization_id)")
def _drop(t):
    return Q.drop_orphans(t.tasks, t.campaigns, "campaign_id").select("id", "campaign_id")


@query("quality_null_orphans", "SELECT t.id, c.id AS campaign_id FROM tasks t LEFT JOIN campaigns c ON c.id = t.campaign_id AND c.organization_id = t.organization_id")
def _null(t):
    return Q.null_orphans(t.tasks, t.campaigns, "campaign_id").select("id", "campaign_id")


@query(
    "quality_same_org",
    """SELECT record_id AS id, organization_id, company_id FROM raw_updates u WHERE company_id IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM companies c WHERE c.id = u.company_id AND c.organization_id = u.organization_id)""",
)
def _same_org(t):
    rows = t.raw_updates.withColumnRenamed("record_id", "id")
    return Q.same_org(rows, t.companies, "company_id").select("id", "organization_id", "company_id")


@query(
    "quality_allowed_values",
    """SELECT id, CASE status WHEN 'in_review' THEN 'pending' ELSE CASE WHEN status IN ('pending','in_progress','completed','cancelled','scheduled','failed') THEN status ELSE 'failed' END END AS status FROM tasks""",
)
def _allowed(t):
    return Q.allowed_values(t.tasks, "status", ["pending", "in_progress", "completed", "cancelled", "scheduled", "failed"], "failed", {"in_review": "pending"}).select("id", "status")


@query("quality_unique", "SELECT organization_id, company_id, count(*) AS rows FROM deals WHERE closed_at IS NULL GROUP BY 1, 2 HAVING count(*) > 1")
def _unique(t):
    return Q.unique(t.deals, ["organization_id", "company_id"], F.col("closed_at").isNull())


@query(
    "quality_table_contract",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, {str(k).upper()} AS has_primary_key, (SELECT count(*) FROM {n}) AS rows"
        for n, k in (("usage", True), ("contacts", False), ("companies", False), ("tasks", False), ("deals", True))
    ),
)
def _contract(t):
    names = ("usage", "contacts", "companies", "tasks", "deals")
    return Q.table_contract({n: getattr(t, n) for n in names}, {"usage": ["id"], "deals": ["id"]}).select("table_name", "has_primary_key", "rows")


_KIND = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'FLOAT[]' THEN 'array<float>' END"
_CHECKED = ("nation", "customer", "part", "supplier", "documents", "embeddings", "labels")


@query(
    "quality_table_contract_hash",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, (SELECT md5(string_agg(column_name || ':' || {_KIND} || ':false', '|')) FROM (DESCRIBE {n})) AS column_contract_hash, "
        f"(SELECT CAST(count(*) AS INT) FROM (DESCRIBE {n})) AS columns, (SELECT count(*) FROM {n}) AS rows"
        for n in _CHECKED
    ),
)
def _contract_hash(t):
    return Q.table_contract({n: getattr(t, n) for n in _CHECKED}).drop("has_primary_key")


_FP = "version AS v, coalesce(size, 0) AS s, nullif(etag, '') AS e, nullif(mimetype, '') AS m, nullif(cache_control, '') AS c, coalesce(user_metadata, '{}') AS u"


@query(
    "quality_manifest_diff",
    f"""WITH o AS (SELECT bucket_id, name, {_FP} FROM objects_before), n AS (SELECT bucket_id, name, {_FP} FROM objects_after)
    SELECT coalesce(n.bucket_id, o.bucket_id) AS bucket_id, coalesce(n.name, o.name) AS name, CASE WHEN n.name IS NULL THEN 'removed' WHEN o.name IS NULL THEN 'added'
      WHEN (o.v, o.s, o.e, o.m, o.u) IS DISTINCT FROM (n.v, n.s, n.e, n.m, n.u) OR o.c IS DISTINCT FROM n.c THEN 'changed' ELSE 'unchanged' END AS change
    FROM o FULL JOIN n ON n.bucket_id = o.bucket_id AND n.name = o.name""",
)
def _manifest(t):
    return Q.manifest_diff(t.objects_before, t.objects_after).select("bucket_id", "name", "change")


@query(
    "quality_links_from_key",
    """SELECT DISTINCT organization_id, id AS child_id, company_id FROM email_copy_drafts d WHERE company_id IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.organization_id = d.organization_id AND t.id = d.id AND t.company_id = d.company_id)""",
)
def _links(t):
    known = t.tasks.withColumnRenamed("id", "child_id")
    return Q.links_from_key(t.email_copy_drafts, "company_id", known)


@query(
    "quality_remove_references",
    """SELECT c.id, CASE WHEN file_ids_text IS NOT NULL THEN coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT unnest(string_split(file_ids_text, ',')) AS f) x JOIN stored_files s ON s.id = x.f AND s.organization_id = c.organization_id), '') END AS file_ids FROM companies c""",
)
def _references(t):
    rows = t.companies.withColumn("file_ids", F.split("file_ids_text", ","))
    return Q.remove_references(rows, "file_ids", t.stored_files).select("id", F.array_join("file_ids", ",").alias("file_ids"))


@query("quality_file_links", "SELECT l.* FROM file_links l JOIN stored_files f ON f.id = l.file_id AND f.organization_id = l.organization_id")
def _file_links(t):
    return Q.drop_orphans(t.file_links, t.stored_files, "file_id").select("id", "organization_id", "file_id")


@query(
    "quality_fill_nulls",
    "SELECT id, coalesce(sent_at, created_at) AS sent_at, coalesce(send_status, 'not_sent') AS send_status, coalesce(body, '') AS body FROM tasks",
)
def _fill(t):
    return Q.fill_nulls(t.tasks, {"sent_at": F.col("created_at"), "send_status": "not_sent", "body": ""}).select("id", "sent_at", "send_status", "body")


# ---------------------------------------------------------------- imports


@query(
    "import_raw_records",
    """SELECT 'l1' AS list_id, p_name, CASE WHEN trim(CASE WHEN p_size > 25 THEN p_brand ELSE '' END) <> '' THEN 'person' WHEN trim(p_type) <> '' AND p_size > 10 THEN 'company' ELSE 'unknown' END AS record_type, 'pending' AS import_status FROM part""",
)
def _records(t):
    rows = t.part.select(
        F.col("p_name").alias("Note"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("E-mail"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("Company Name")
    )
    return io.raw_records(rows, "l1").select("list_id", F.get_json_object("raw_data", "$.Note").alias("p_name"), "record_type", "import_status")


@query(
    "import_explode_json_array",
    """WITH c AS (SELECT id, unnest(from_json(curated_companies, '[{"id":"VARCHAR","selected":"BOOLEAN"}]')) AS x FROM campaigns) SELECT id AS campaign_id, x.id AS company_id, x.selected AS selected FROM c""",
)
def _explode(t):
    rows = t.campaigns.select(F.col("id").alias("campaign_id"), "curated_companies")
    return io.explode_json_array(rows, "curated_companies", "struct<id: string, selected: boolean>").withColumnRenamed("id", "company_id")


# ---------------------------------------------------------------- search

_SIM = "list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_Q = "q AS (SELECT embedding FROM chunks WHERE id = 'ch0')"


def _query_vector(t):
    return S._vector_of(t.chunks, "ch0")


@query("search_match_chunks", f"WITH {_Q} SELECT id, organization_id, round({_SIM}, 6) AS similarity FROM chunks c, q WHERE c.embedding IS NOT NULL AND {_SIM} > 0.1 ORDER BY {_SIM} DESC, id LIMIT 25")
def _match(t):
    return S.match_chunks(t.chunks, _query_vector(t), 0.1, 25).select("id", "organization_id", F.round("similarity", 6).alias("similarity"))


@query(
    "search_similar_chunks",
    f"WITH {_Q} SELECT id, round({_SIM}, 6) AS similarity FROM chunks c, q WHERE c.organization_id = 'org_0' AND id <> 'ch0' AND c.embedding IS NOT NULL AND {_SIM} > 0.1 ORDER BY {_SIM} DESC, id LIMIT 5",
)
def _similar(t):
    return S.similar_chunks(t.chunks, "ch0", 0.1, 5, org_id="org_0").select("id", F.round("similarity", 6).alias("similarity"))


@query("search_content", f"WITH {_Q} SELECT id, url, chunk_text AS content, round({_SIM}, 6) AS similarity FROM chunks c, q WHERE c.embedding IS NOT NULL AND {_SIM} > 0.1 ORDER BY {_SIM} DESC, id LIMIT 10")
def _content(t):
    return S.content(t.chunks, _query_vector(t), 0.1, 10).select("id", "url", "content", F.round("similarity", 6).alias("similarity"))


@query("search_text", f"WITH {ranks('chunks', 'chunk_text', 'The thon, THTH')} SELECT id, round(r, 6) AS text_rank FROM rank")
def _text(t):
    return S.search_text(t.chunks, "chunk_text", "The thon, THTH").select("id", F.round("text_rank", 6).alias("text_rank"))


@query("search_text_forms", f"WITH {ranks('chunks', 'chunk_text', 'Having Ones, the tioned areing')} SELECT id, round(r, 6) AS text_rank FROM rank")
def _text_forms(t):
    return S.search_text(t.chunks, "chunk_text", "Having Ones, the tioned areing").select("id", F.round("text_rank", 6).alias("text_rank"))


def _hybrid_sql(text):
    return f"""WITH {_Q}, {ranks('chunks', 'chunk_text', text)}, s AS (SELECT c.id, coalesce(r, 0) AS tr, coalesce({_SIM}, 0) AS vs FROM chunks c CROSS JOIN q LEFT JOIN rank ON rank.id = c.id)
    SELECT id, round(tr, 6) AS text_rank, round(vs, 6) AS vector_similarity, round(0.3::DOUBLE * tr + 0.7::DOUBLE * vs, 6) AS combined_score FROM s WHERE 0.3::DOUBLE * tr + 0.7::DOUBLE * vs > 0.1 ORDER BY 0.3::DOUBLE * tr + 0.7::DOUBLE * vs DESC, id LIMIT 20"""


def _hybrid_rows(t, text):
    rows = S.hybrid(t.chunks, text, _query_vector(t), threshold=0.1, k=20)
    return rows.select("id", *(F.round(c, 6).alias(c) for c in ("text_rank", "vector_similarity", "combined_score")))


@query("search_hybrid", _hybrid_sql("the thon thth"))
def _hybrid(t):
    return _hybrid_rows(t, "the thon thth")


@query("search_hybrid_forms", _hybrid_sql("being Oning, Tions"))
def _hybrid_forms(t):
    return _hybrid_rows(t, "being Oning, Tions")


@query("search_names", "SELECT id, name FROM contacts WHERE name ILIKE '%VAN last2%'")
def _names(t):
    return S.search_names(t.contacts, "name", "VAN last2").select("id", "name")


def _name_index(t):
    """The trigram table of the contacts' names."""
    return NameIndex(t.spark, written_once(t, "names", lambda folder: NameIndex(t.spark, folder).build(t.contacts)))


@query("search_names_indexed", "SELECT id, name FROM contacts WHERE name ILIKE '%VAN last2%'")
def _names_indexed(t):
    return _name_index(t).containing(t.contacts, "VAN last2").select("id", "name")


def _trigrams_sql(text: str) -> str:
    words = f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


# every fiftieth contact is looked for by a misspelt name
_ASKED = "CAST(substr(id, 3) AS INT) % 50 = 0"


@query(
    "search_names_similar",
    f"""WITH n AS (SELECT id, {_trigrams_sql('name')} AS t FROM contacts), q AS (SELECT id AS query, {_trigrams_sql("replace(replace(name, 'rst', 'rts'), 'van', 'vam')")} AS t FROM contacts WHERE {_ASKED}),
    s AS (SELECT query, id, len(list_intersect(q.t, n.t)) AS k, len(q.t) AS a, len(n.t) AS b FROM q, n)
    SELECT query, id, round(k / (a + b - k), 6) AS similarity FROM s WHERE k > 0 AND k / (a + b - k) >= 0.45""",
)
def _names_similar(t):
    text = F.replace(F.replace(F.col("name"), F.lit("rst"), F.lit("rts")), F.lit("van"), F.lit("vam"))
    asked = t.contacts.filter(F.expr(_ASKED)).select(F.col("id").alias("query"), text.alias("text"))
    return _name_index(t).similar(t.contacts, asked, 0.45).withColumn("similarity", F.round("similarity", 6))
