"""Matching on worked totals, and parsers on small pages."""

import json


from pyspark.sql import functions as F

from loomline import schema
from loomline.functions import titles
from loomline.operators import match
from loomline.sources import catalogue_html, jsonld, snapshots, timetable

from .items import NOW, frame, item, source

OFFICIAL = [source("Official", "official")]


def subject(id_, name, date="2026-07-03", name_cn=None, type_=2, eps=12, platform="TV", box=(), **more):
    row = dict.fromkeys(schema.SUBJECT.fieldNames()) | {"id": id_, "type": type_, "name": name, "name_cn": name_cn, "date": date, "platform": platform, "eps": eps, "infobox": [{"key": k, "value": v} for k, v in box]} | more
    return tuple(row[f] for f in schema.SUBJECT.fieldNames())


def score(spark, it, subjects):
    s = snapshots.with_facts(spark.createDataFrame(subjects, schema.SUBJECT))
    pairs = frame(spark, [it]).select(F.struct("*").alias("i")).crossJoin(s.select(F.struct("*").alias("s"))).withColumn("from_month", F.lit(False))
    return {r.s.id: r for r in match.finalized(match.scored(pairs)).collect()}


def entry(title, japanese=True, **more):
    form = {"original": title, "japanese": title if japanese else None, "chinese": None, "english": None, "aliases": []}
    return item("i", title=form, **({"episodeCount": 12, "sources": []} | more))


def test_worked_totals(spark):
    r = score(spark, entry("星の物語"), [subject(1, "星の物語")])[1]
    assert (r.score, r.confidence) == (85, "high")
    r = score(spark, entry("星の物語"), [subject(1, "星の物語"), subject(2, "星の物語", "2026-07-04")])
    assert (r[1].final, r[1].confidence, r[2].score) == (65, "medium", 81) and "multiple_close_candidates" in r[1].risks
    r = score(spark, entry("SPY FAMILY", sources=OFFICIAL), [subject(1, "SPY×FAMILY")])[1]
    assert (r.score, r.confidence) == (87, "high")
    chinese = entry("中文标题", episodeCount=None, startDate=None, primarySeason=None) | {"title": {"original": "Unlike Anything", "japanese": None, "chinese": "中文标题", "english": None, "aliases": []}}
    r = score(spark, chinese, [subject(1, "ぜんぜんちがう", None, "中文标题", eps=None)])[1]
    assert (r.score, r.confidence) == (51, "medium") and "chinese_title_only" in r.risks
    r = score(spark, entry("星の物語"), [subject(1, "星の物語", "2020-07-03")])[1]
    assert (r.score, r.confidence) == (40, "low") and "year_mismatch" in r.risks
    r = score(spark, entry("星の物語 第2期"), [subject(1, "星の物語 第1期")])[1]
    assert (r.score, r.confidence) == (62, "low") and "season_token_mismatch" in r.risks
    r = score(spark, entry("星の物語", episodeCount=None), [subject(1, "星の物語", type_=1)])[1]
    assert "format_conflict" in r.risks and r.confidence == "low"


def test_titles():
    t = titles.normal("SPY×FAMILY 第2期")
    assert t.compact == "spyfamily第2期" and t.token == ("season", 2)
    assert titles.season_token("part 2") == ("part", 2) and titles.season_token("Final Season") == ("final", None) and titles.season_token("3rd season") == ("season", 3) and titles.season_token("新章") == ("sequel", None) and titles.season_token("plain") is None
    assert titles.normal("間諜過家家").simplified == "间谍过家家" and titles.number("二十一") == 21
    assert titles.search_titles([("original", "夏目 (完)"), ("chinese", "夏目")])[0] == "夏目 (完)" and len(titles.search_titles([("alias", f"题{i} 第{i}季") for i in range(9)])) == 8
    assert titles.edit_distance("kitten", "sitting") == 3


def test_candidates_come_from_blocks(spark):
    items = frame(spark, [item("a", "星の物語"), item("b", "べつの話", startDate="2020-01-01", primarySeason={"year": 2020, "quarter": "winter"})]).select(F.struct("*").alias("i"))
    subjects = snapshots.with_facts(spark.createDataFrame([subject(1, "星の物語", "2019-01-01"), subject(2, "むかんけい", "2026-08-01"), subject(3, "とおい", "2001-01-01")], schema.SUBJECT)).select(F.struct("*").alias("s"))
    got = {(r.i.id, r.s.id, r.from_month) for r in match.candidate_pairs(items, subjects).collect()}
    assert got == {("a", 1, False), ("a", 2, True)}
    ok = match.finalized(match.scored(match.candidate_pairs(items, subjects))).select("s.id", match.accepted().alias("ok")).collect()
    assert not any(r.ok for r in ok)
    r = score(spark, entry("星の物語"), [subject(1, "星の物語")])
    assert r[1].lead == 100
    known = spark.range(1).select(match.known_subject(F.struct(F.lit("Record of Ragnarok").alias("original"), *(F.lit(None).cast("string").alias(x) for x in ("japanese", "chinese", "english")), F.array().cast("array<string>").alias("aliases")), F.lit(None).cast("string")).alias("k")).first().k
    assert known == 322900


def test_placeholder(spark):
    made = snapshots.placeholder(spark, 2026, 7, NOW)
    r = made.first()
    assert (r.id, r.title.original, r.startDate, r.primarySeason.quarter, r.inclusionStatus) == ("anime:mock-bangumi-2026-summer", "Mock Bangumi 2026 summer", "2026-07-01", "summer", "needs_review")
    assert made.schema.simpleString() == schema.ITEM.simpleString() and r.sources == [] and r.schedule == [] and [tuple(s) for s in r.activeSeasons] == [(2026, "summer")]


def test_snapshots(spark, tmp_path):
    one = {"id": 1, "type": 2, "name": "銀河".encode().decode("latin-1"), "name_cn": "银河", "date": "2026-07-03", "platform": "TV", "eps": 1, "rating": {"score": 7.1, "total": 60, "rank": 3}, "images": {"large": "l", "common": "c"},
           "infobox": [{"key": "别名", "value": [{"v": "Galaxy"}, {"v": "银河"}]}, {"key": "官方网站", "value": "https://g.jp/"}, {"key": "动画制作", "value": "MAPPA"}], "tags": [{"name": "TV", "count": 3}]}
    (tmp_path / "db-202607-subjects.json").write_text("﻿" + json.dumps([one, {"id": 2, "type": 1, "name": "x"}, {"id": 3, "type": 2, "name": ""}], ensure_ascii=False))
    (tmp_path / "db-202608-subjects.json").write_text(json.dumps({"data": [dict(one, eps=12), {"id": 4, "type": 2, "name": "Paw Patrol"}]}, ensure_ascii=False))
    found = snapshots.read(spark, str(tmp_path))
    assert sorted((r.month, r.id) for r in found.collect()) == [(2026 * 12 + 6, 1), (2026 * 12 + 7, 1), (2026 * 12 + 7, 4)]
    assert snapshots.read(spark, str(tmp_path), [(2026, 8)]).count() == 2 and snapshots.read(spark, str(tmp_path), [(2020, 1)]).count() == 0
    assert {r.id: r.eps for r in snapshots.latest(found).collect()} == {1: 12, 4: None}
    eps = [(1, 1.0, 1.0, "e1", None, "2026-07-03", 1, 0), (2, 2.0, 2.0, "e2", "二", "2026-07-10", 1, None), (3, 3.0, 3.0, "sp", None, "2026-07-11", 1, 1), (4, 4.0, None, "e", None, "soon", 1, 0)]
    items = {r.id: r for r in snapshots.to_items(snapshots.read(spark, str(tmp_path), [(2026, 7)]), NOW, spark.createDataFrame(eps, schema.SUBJECT_EPISODE)).collect()}
    a = items["anime:1"]
    assert a.title.original == "銀河" and a.title.aliases == ["Galaxy"] and a.officialUrl == "https://g.jp/" and a.staff.studio == ["MAPPA"] and a.isJapaneseAnime and a.coverImage.small is None and a.coverImage.medium == "c"
    assert [(e.episodeNumber, e.episodeTitle) for e in a.schedule] == [(1, "e1"), (2, "二")] and a.updateWeekday == 5 and (a.episodeCount, a.airedEpisodeCount, a.dataStatus) == (None, 2, "partial")
    b = {r.id: r for r in snapshots.to_items(snapshots.read(spark, str(tmp_path), [(2026, 8)]), NOW).collect()}
    assert b["anime:4"].inclusionStatus == "excluded" and b["anime:4"].exclusionReason == "Not Japanese anime" and b["anime:1"].endDate == "2026-09-18" and b["anime:1"].status == "airing"


BLOCK = '<!--#{m}--><p class="title_cn_r">{cn}</p><p class="title_jp">{jp}</p><td class="type_a">漫画改编</td><td class="type_tag_a">x</td><td class="staff_r">动画制作：MAPPA、ufotable</td><p class="broadcast_r">{b}</p><p class="broadcast_ex_r">全12话</p><a href="https://o.jp/?a=1&amp;b=2" target="_blank">官网</a><img src="https://i/x.jpg">'


def page(*blocks, year=2026, season=7):
    return ("https://page", "<html>" + "".join(blocks) + '<p class="future_intro_x">tail <p class="title_cn">no</p></body>', year, season, NOW)


def test_catalogue_pages(spark):
    b = lambda m, cn="甲", jp="こう / Kou", slot="7/9周四深夜 24:30": BLOCK.format(m=m, cn=cn, jp=jp, b=slot)
    pages = spark.createDataFrame([page(b("B-P3", "乙"), b("B-P3", "丙"), b("a01", "丁", slot="6/3先行6话 7/9周四 23:30"), b("A", "戊", slot="未定"))], "url string, html string, year int, season int, retrievedAt string")
    found = catalogue_html.entries(pages)
    got = {r.titleChinese: r for r in found.collect()}
    assert {k: r.id for k, r in got.items()} == {"乙": "B01", "丙": "B02", "丁": "A01", "戊": "A02"} and got["丁"].officialUrl == "https://o.jp/?a=1&b=2" and got["丁"].coverImageUrl == "https://i/x.jpg" and got["丁"].url == "https://page#a01"
    items = {r.title.chinese: r for r in catalogue_html.to_items(found, NOW).collect()}
    a = items["丁"]
    assert (a.id, a.startDate, a.updateTime, a.episodeCount, a.title.english, a.staff.studio, a.staff.originalWorkType) == ("anime:yucwiki:202607:a01", "2026-07-09", "23:30", 12, "Kou", ["MAPPA", "ufotable"], "manga")
    assert "戊" not in items and [r.titleChinese for r in catalogue_html.unscheduled(found).collect()] == ["戊"] and catalogue_html.next_season(2026, 10) == (2027, 1)
    slots = spark.createDataFrame([("12/28 23:00", 2026, 1), ("6/3先行", 2026, 7), ("x", 2026, 7)], "t string, y int, s int").select(catalogue_html.slot(F.col("t"), F.col("y"), F.col("s")).alias("r")).collect()
    assert [r.r and tuple(r.r) for r in slots] == [("2025-12-28", "23:00"), ("2026-06-03", None), None]


def test_json_ld(spark):
    payload = json.dumps({"@graph": [{"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": {"@type": "TVSeries", "name": " 星 ", "alternateName": ["Hoshi", "Hoshi"], "datePublished": "2026-07-17T23:30:00+09:00", "numberOfEpisodes": "12", "sameAs": ["https://bgm.tv/subject/77"]}}]}]}, ensure_ascii=False)
    html = f'<script type="application/ld+json">{payload.replace(chr(34), "&quot;")}</script><script type="application/ld+json">{{broken</script>'
    pages = spark.createDataFrame([("https://l/", html, "2026-07-01T00:00:00Z"), ("https://l/", html, "2026-07-01T00:00:00Z"), ("https://m/", None, None)], "url string, html string, retrievedAt string")
    found = jsonld.entries(pages)
    assert [(r.title, r.aliases, r.episodeCount, r.bangumiSubjectId) for r in found.collect()] == [("星", ["Hoshi"], 12, 77)]
    a = jsonld.to_items(found, NOW).first()
    assert (a.id, a.startDate, a.updateTime, a.updateWeekday, a.status, a.officialUrl) == ("anime:77", "2026-07-17", "22:30", 5, "announced", "https://l/")


def test_timetables(spark):
    text = "<p>7/10（五）</p>21:30《甲》<br>22:5 乙 更新<br>《丙》 7/11 每週六 23:00<br>《丁》 2026/7/12 08:00 上架<br>nothing"
    found = timetable.entries(spark.createDataFrame([("https://t/?sn=9", text, 2026, NOW)], "url string, text string, year int, retrievedAt string"))
    assert sorted((r.title, r.uploadDate, r.uploadTime, r.sn) for r in found.collect()) == sorted([("甲", "2026-07-10", "21:30", "9"), ("乙", "2026-07-10", "22:05", "9"), ("丙", "2026-07-11", "23:00", "9"), ("丁", "2026-07-12", "08:00", "9")])
    a = {r.title.original: r for r in timetable.to_items(found, NOW).collect()}
    assert a["丙"].updateWeekday == 6 and a["丙"].id == "anime:bahamut:9" and a["丙"].sources[0].type == "streaming_platform"




def test_edit_distance_is_the_plain_one():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    texts = ["", "a", "ab", "ba", "星の物語", "星の話", "small ring", "small  rings", "x" * 70, "x" * 69 + "y"]
    assert all(titles.edit_distance(a, b) == plain(a, b) for a in texts for b in texts)
    pairs = [(titles.normal(a), titles.normal(b)) for a in texts for b in texts]
    assert all(titles.alike(a, b) == (s if (s := titles.similarity(a.plain, b.plain)) >= titles.ALIKE else 0) for a, b in pairs)


def test_pairs_are_not_broadcast(spark, tmp_path):
    """Files that are small by compression may hold more rows than a driver does; and no season is not a season that two rows share."""
    frame(spark, [item("a", "星の物語", startDate=None, primarySeason=None), item("b", "べつの話")]).select(F.struct("*").alias("i")).write.parquet(f"{tmp_path}/i")
    snapshots.with_facts(spark.createDataFrame([subject(1, "星の物語", None), subject(2, "むかんけい", None)], schema.SUBJECT)).select(F.struct("*").alias("s")).write.parquet(f"{tmp_path}/s")
    pairs = match.candidate_pairs(spark.read.parquet(f"{tmp_path}/i"), spark.read.parquet(f"{tmp_path}/s"))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert [(r.i.id, r.s.id) for r in pairs.select("i", "s").collect()] == [("a", 1)]


def test_ranks_and_leads_take_one_shuffle(spark):
    rows = spark.createDataFrame([("a", 1, 2, 80, [])], "i string, s long, type int, score int, risks array<string>")
    ranked = match.finalized(rows.select(F.struct(F.col("i").alias("id")).alias("i"), F.struct(F.col("s").alias("id"), "type").alias("s"), "score", "risks"))
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
