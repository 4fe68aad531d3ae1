"""Structuring of curricula vitae: dates, tenures, degrees, hierarchies, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.sources.workspace import written

#: Degrees from the lowest rank to the highest that count towards the highest degree.
DEGREE_RANKS = {"初中": 1, "高中": 2, "中专": 2, "大专": 3, "专升本": 4, "本科": 5, "双学位": 6, "硕士": 7, "MBA": 7, "EMBA": 7, "博士": 8}


def year_month_day(text: Column) -> dict[str, Column]:
    """Year, month and day as written at the start of a date, month and day held to 1-12 and 1-31."""
    t = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?U)\s+", "")
    part = lambda p, i: F.expr("try_cast(NULL AS INT)") if p is None else F.when(F.regexp_extract(t, p, i) != "", F.regexp_extract(t, p, i).cast("int"))
    pattern = r"([0-9]{4})[^0-9]?([0-9]{1,2})?[^0-9]?([0-9]{1,2})?"
    held = lambda c, most: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(1)), F.lit(most)))
    return {"year": part(pattern, 1), "month": held(part(pattern, 2), 12), "day": held(part(pattern, 3), 31)}


def from_epoch(value: Column) -> Column:
    """Seconds or milliseconds since 1970 as a timestamp; other texts give null."""
    n = F.expr("1") * value.cast("string").try_cast("bigint")
    return F.when(n.isNotNull(), F.timestamp_seconds(F.when(n > 99_999_999_999, (n / 1000).cast("bigint")).otherwise(n)))


def tenures(jobs: DataFrame, person: str, start: str, end: str) -> DataFrame:
    """person, jobs, first_start, last_end, mean_days, total_days."""
    days = F.datediff(F.col(end), F.col(start))
    return jobs.groupBy(person).agg(F.count("*").alias("jobs"), F.min(start).alias("first_start"), F.max(end).alias("last_end"), F.round(F.avg(days), 6).alias("mean_days"), F.sum(days).alias("total_days"))


def highest_degree(studies: DataFrame, person: str, degree: str) -> DataFrame:
    """person, degree, rank: the degree of the highest rank, the first by name of equals."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DEGREE_RANKS.items() for x in kv]), F.col(degree)), F.lit(0))
    best = studies.where(F.col(degree).isNotNull()).groupBy(person).agg(F.min(F.struct((-rank).alias("r"), F.col(degree).alias("d"))).alias("m"))
    return best.select(person, F.col("m.d").alias("degree"), (-F.col("m.r")).alias("rank"))


def hierarchy_paths(nodes: DataFrame, key: str, name: str, parent: str, written_every: int = 8) -> DataFrame:
    """key, path: names from the node to its root, however deep; a path that meets one of its own nodes again ends there.

    A self-join a level, on a dimension table; the lineage is cut by a written table every few levels.
    """
    up = nodes.select(F.col(key).alias("_k"), F.col(name).alias("_n"), F.col(parent).alias("_p"))
    at = nodes.select(key, F.array(name).alias("path"), F.array(key).alias("_met"), F.col(parent).alias("_up"))
    level = 0
    while at.where("_up IS NOT NULL").limit(1).count():
        known = F.col("_k").isNotNull() & ~F.array_contains("_met", F.col("_k"))
        joined = at.join(up, at["_up"] == up["_k"], "left")
        at = joined.select(
            key,
            F.when(known, F.concat("path", F.array("_n"))).otherwise(F.col("path")).alias("path"),
            F.when(known, F.concat("_met", F.array("_k"))).otherwise(F.col("_met")).alias("_met"),
            F.when(known, F.col("_p")).alias("_up"),
        )
        level += 1
        if level % written_every == 0:
            at = written(at, "hierarchy")
    return at.select(key, "path")


def completeness(fields: list[Column], penalties: list[tuple[Column, float]]) -> Column:
    """Share of filled fields, times each penalty whose condition holds."""
    filled = sum((F.when(F.coalesce(f.cast("string"), F.lit("")) != "", 1).otherwise(0) for f in fields[1:]), F.when(F.coalesce(fields[0].cast("string"), F.lit("")) != "", 1).otherwise(0))
    score = filled / F.lit(float(len(fields)))
    for condition, factor in penalties:
        score = score * F.when(condition, F.lit(factor)).otherwise(F.lit(1.0))
    return score


def normal_company(name: Column) -> Column:
    """Lower case, half width, without brackets' contents and the common legal endings."""
    t = F.lower(F.regexp_replace(name, r"[\(（][^()（）]*[\)）]", ""))
    t = F.regexp_replace(t, r"[\t &（）()\"':：;；,，]+", "")
    #: Legal forms at the end of company names.
    return F.regexp_replace(t, "(集团)?(股份)?(有限)?(责任)?(公司|集团|co\\.?ltd\\.?|inc\\.?|corp\\.?)$", "")


#: Parts of a raw record that hold several entries, and parts that are dropped.
ENTRY_PARTS = ("education", "work", "certificate", "project", "language", "skill", "training")
DROPPED_PARTS = ("raw_txt", "parser_name", "inference", "ori_text", "use_time", "time_stat")
#: What the basics take from the latest job and the latest school, and names that change.
FROM_WORK = ("annual_salary_from", "annual_salary_to", "industry_name", "position_name", "responsibilities", "corporation_type", "scale", "corporation_name")
FROM_SCHOOL = ("school_name", "discipline_name")
RENAMED = {"basic_salary_month": "salary_month", "expect_annual_salary_from": "expect_annual_salary"}

_MAP = "map<string,string>"


def _overlaid(base: Column, more: Column) -> Column:
    """A map with another's entries put over its own."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(base), lambda e: ~F.array_contains(F.map_keys(more), e["key"])), F.map_entries(more)))


def _known(names: list[Column], values: list[Column]) -> Column:
    """A map of those pairs whose value isn't null."""
    pairs = F.array(*[F.struct(n.alias("key"), v.cast("string").alias("value")) for n, v in zip(names, values, strict=True)])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def _without(of: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(of, lambda k, v: ~k.isin(list(names)))


def clean_records(raw: DataFrame, content: str, now: str) -> DataFrame:
    """Raw records (JSON) as maps: basic, contact, a map of entries by their place for each part that has several, and the rest.

    Entries may come as a list or as an object of objects. The basics take the start of the earliest job, whether any job was in
    management, and fields of the latest job and school, by start time. All are expressions on the record's own row.
    """
    empty = F.create_map().cast(_MAP)
    top = raw.withColumn("_top", F.from_json(content, _MAP))
    part = lambda name: F.coalesce(F.from_json(F.col("_top")[name], _MAP), empty)
    text = lambda name: F.trim(F.col("_top")[name])
    entries = {
        n: F.when(F.startswith(text(n), F.lit("[")), F.from_json(text(n), f"array<{_MAP}>")).when(F.startswith(text(n), F.lit("{")), F.map_values(F.from_json(text(n), f"map<string,{_MAP}>")))
        for n in ENTRY_PARTS
    }
    top = top.withColumns({f"_{n}": F.transform(e, lambda x: F.map_filter(x, lambda k, v: (k != "external") | v.isNull())) for n, e in entries.items()})
    top = top.withColumns({"_basic": _without(part("basic"), ("photo2",)), "_contact": part("contact")})

    def ends(name: str) -> tuple[Column, Column]:
        """The entries of the least and the greatest start time; of equals the first and the last."""
        starts = F.transform(F.col(f"_{name}"), lambda e, i: F.struct(F.coalesce(e["start_time"], F.lit("")).alias("s"), i.alias("i")))
        return F.get(F.col(f"_{name}"), F.array_min(starts)["i"]), F.get(F.col(f"_{name}"), F.array_max(starts)["i"])

    basic = F.col("_basic")
    for old, new in RENAMED.items():
        named = _overlaid(_without(basic, (old,)), F.create_map(F.lit(new), basic[old]))
        basic = F.when(F.coalesce(basic[old], F.lit("")).isin("", "0"), basic).otherwise(named)
    first_job, last_job = ends("work")
    _, last_school = ends("education")
    managed = F.when(F.exists("_work", lambda e: F.coalesce(e["management_experience"] == "Y", F.lit(False))), "Y").otherwise("N")
    worked = _known(
        [F.lit(n) for n in ("work_start_time", "management_experience", "annual_salary", *FROM_WORK)],
        [F.coalesce(first_job["start_time"], F.lit("")), managed, F.coalesce(last_job["annual_salary_from"], F.lit("0")), *[F.coalesce(last_job[n], F.lit("")) for n in FROM_WORK]],
    )
    top = top.withColumn("_basic", basic)
    top = top.withColumn("_basic", F.when(F.size("_work") > 0, _overlaid(F.col("_basic"), worked)).otherwise(F.col("_basic")))
    studied = _known([F.lit(n) for n in FROM_SCHOOL], [last_school[n] for n in FROM_SCHOOL])
    top = top.withColumn("_basic", F.when(F.size("_education") > 0, _overlaid(F.col("_basic"), studied)).otherwise(F.col("_basic")))
    named = F.coalesce(F.nullif(F.col("_contact")["name"], F.lit("")), F.col("_basic")["name"], F.lit(""))
    by_place = {n: F.map_from_entries(F.transform(f"_{n}", lambda e, i: F.struct(i.cast("string").alias("key"), e.alias("value")))).alias(n) for n in ENTRY_PARTS}
    return top.select(
        *[c for c in raw.columns if c != content],
        F.lit(0).alias("is_deleted"),
        _overlaid(F.col("_basic"), F.create_map(F.lit("updated_at"), F.lit(now))).alias("basic"),
        _overlaid(F.col("_contact"), F.create_map(F.lit("name"), named)).alias("contact"),
        *by_place.values(),
        _without(F.col("_top"), (*DROPPED_PARTS, *ENTRY_PARTS, "basic", "contact", "is_deleted")).alias("rest"),
    )


#: Fixed value: endings of region names.
REGION_END = "(省|市|区|县|自治区|特别行政区|地区|盟|州)$"


def regions_named(rows: DataFrame, text: str, names: DataFrame, column: str = "name") -> DataFrame:
    """Adds is_region: whether the text names a region, with or without the endings of either. names: a lookup table."""
    known = names.select(F.regexp_replace(column, REGION_END, "").alias("_region")).distinct()
    marked = rows.withColumn("_bare", F.regexp_replace(text, REGION_END, "")).join(known, F.col("_bare") == F.col("_region"), "left")
    return marked.withColumn("is_region", F.col("_region").isNotNull()).drop("_bare", "_region")


def good_companies(rows: DataFrame, company: str, good: DataFrame, name: str = "name") -> DataFrame:
    """Adds is_good: whether a listed company's normal name is part of the row's, both as `normal_company` gives them.

    Substrings of the row's name are looked up by equality, so no two tables meet as a whole. good: a lookup table.
    """
    listed = good.select(normal_company(F.col(name)).alias("_good")).where("_good <> ''").distinct()
    own = rows.select(F.col(company).alias("_c")).distinct().withColumn("_n", normal_company(F.col("_c")))
    n = F.length("_n")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda j: F.substring(F.col("_n"), i, j))))
    hit = own.where(n > 0).select("_c", F.explode(F.array_distinct(parts)).alias("_part")).join(listed, F.col("_part") == F.col("_good"), "left_semi").select("_c").distinct()
    marked = rows.join(hit.withColumn("is_good", F.lit(True)), rows[company].eqNullSafe(hit["_c"]), "left")
    return marked.drop("_c").withColumn("is_good", F.coalesce("is_good", F.lit(False)))


def matched_schools(studies: DataFrame, schools: DataFrame, name: str) -> DataFrame:
    """Studies with the school whose name, foreign name or alias they state. schools: school_id, name_cn, name_en, aliases."""
    names = F.explode(F.array_distinct(F.array_compact(F.concat(F.array("name_cn", "name_en"), F.coalesce("aliases", F.array().cast("array<string>"))))))
    flat = schools.select("school_id", names.alias("_n")).select("school_id", F.lower(F.regexp_replace("_n", r"\s+", "")).alias("_n")).groupBy("_n").agg(F.min("school_id").alias("school_id"))
    return studies.withColumn("_s", F.lower(F.regexp_replace(F.regexp_replace(name, r"[\(（][^()（）]*[\)）]", ""), r"\s+", ""))).join(flat, F.col("_s") == F.col("_n"), "left").drop("_s", "_n")


#: Degrees by number.
DEGREES = {"94": "EMBA", "6": "MBA", "95": "MPA", "92": "专升本", "4": "专科", "90": "中专", "91": "中技", "86": "初中", "3": "博士", "10": "博士后", "1": "本科", "2": "硕士", "87": "职高", "89": "高中"}
#: The columns of a flat record.
FLAT_COLUMNS = (
    "address annual_salary annual_salary_from annual_salary_to birth card certificate_obj city corporation_id corporation_name corporation_type degree discipline_name education_obj email "
    "expect_annual_salary expect_city_names expect_industry_name expect_position_name expect_salary_from expect_salary_to expect_type gender industry_name industry_names is_deleted is_fertility is_house "
    "is_management_experience is_marital is_oversea language_obj name nation phone political_status position_name project_obj responsibilities salary_month scale school_name self_remark skill_obj title_name "
    "tob_resume_id updated_at wechat work_obj work_experience work_start_time"
).split()


def degree_name(number: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DEGREES.items() for x in kv]), number.cast("string")), F.lit(""))


def degree_number(name: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in DEGREES.items() for x in (v, k)]), F.upper(F.trim(name))), F.lit(""))


def flat_records(raw: DataFrame, content: str = "resume_content", industries: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """One flat row of text columns for each JSON record; what isn't stated is empty.

    raw: tob_resume_id, updated_at and content. industries and regions: id, path (names from the entry to its root).
    """
    at = lambda part, name: F.coalesce(F.get_json_object(content, f"$.{part}.{name}"), F.lit(""))
    whole = lambda name: F.coalesce(F.get_json_object(content, f"$.{name}"), F.lit("{}"))
    yes_no = lambda c: F.when(c == "Y", "是").when(c == "N", "否").otherwise("")
    special = {
        "tob_resume_id": F.col("tob_resume_id").cast("string"),
        "updated_at": F.coalesce(F.nullif(at("basic", "updated_at"), F.lit("")), F.col("updated_at").cast("string"), F.lit("")),
        "degree": degree_name(at("basic", "degree")),
        "gender": F.when(at("basic", "gender") == "M", "男").when(at("basic", "gender") == "F", "女").otherwise(""),
        "is_management_experience": yes_no(at("basic", "management_experience")),
        "is_marital": yes_no(at("basic", "marital")),
        "expect_industry_name": F.translate(F.regexp_replace(at("basic", "expect_industry_name"), r'^\["|"\]$|"', ""), ",", " "),
        "phone": F.coalesce(F.nullif(F.trim(at("contact", "phone")), F.lit("")), F.trim(at("contact", "tel"))),
        "industry_names": at("basic", "industry_ids"),
    }
    special |= {c: yes_no(at("basic", c)) for c in ("is_fertility", "is_oversea", "is_house")}
    special |= {c: at("contact", c) for c in ("wechat", "is_deleted", "name", "email")}
    special |= {f"{c}_obj": whole(c) for c in ("education", "work", "certificate", "project", "language", "skill")}
    one_line = lambda c: F.regexp_replace(F.translate(c, "\t", " "), r"\r\n|\n|\r", r"\\n")
    flat = raw.select(*[one_line(special.get(c, at("basic", c))).alias(c) for c in FLAT_COLUMNS])
    if industries is not None:
        ids = flat.select("tob_resume_id", F.posexplode(F.split("industry_names", ",")).alias("i", "id")).join(F.broadcast(industries), "id")  # a fixed lookup table
        named = ids.groupBy("tob_resume_id").agg(F.array_sort(F.collect_list(F.struct("i", "path"))).alias("_p"))
        flat = flat.drop("industry_names").join(named.select("tob_resume_id", F.array_join(F.transform("_p", lambda p: F.array_join(p["path"], " ")), " ").alias("industry_names")), "tob_resume_id", "left")
    if regions is not None:
        flat = flat.join(F.broadcast(regions.select(F.col("id").cast("string").alias("address"), "path")), "address", "left").withColumn("address", F.coalesce(F.array_join("path", " "), F.lit(""))).drop("path")
    return flat.select(*FLAT_COLUMNS)


def project_texts(projects: DataFrame, person: str) -> DataFrame:
    """person, name (of the latest project), text (of all, latest first, without tags). projects: updated_at, name, describe, responsibilities."""
    said = F.regexp_replace(F.concat_ws(" ", F.nullif("describe", F.lit("")), F.nullif("responsibilities", F.lit(""))), "<[^>]+>", "")
    packed = projects.groupBy(person).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("updated_at", F.lit("")).alias("u"), F.coalesce("name", F.lit("")).alias("n"), said.alias("t"))), asc=False).alias("_p"))
    names = F.filter(F.transform("_p", lambda p: p["n"]), lambda n: n != "")
    return packed.select(person, F.get(names, 0).alias("name"), F.array_join(F.filter(F.transform("_p", lambda p: p["t"]), lambda t: t != ""), " ").alias("text"))
