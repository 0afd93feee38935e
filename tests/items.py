"""Builders of items for tests."""

import copy

NOW = "2026-07-28T03:00:00Z"


def source(name="YucWiki", type_="third_party", url=None, scope="japan_broadcast"):
    return {"name": name, "type": type_, "url": url, "retrievedAt": NOW, "confidence": None, "scope": scope}


def episode(day, number=1, time=None, zone="Asia/Tokyo", status="confirmed", src=None):
    return {"episodeNumber": number, "episodeTitle": None, "airDate": day, "airTime": time, "timezone": zone, "status": status, "source": src, "rawTimeText": None}


def item(id_="a", title="タイトル", **fields):
    """A valid item of summer 2026; fields replace its own, dotted ones those of its structs."""
    out = {
        "id": id_, "title": {"original": title, "japanese": title, "chinese": "标题" + id_, "english": None, "aliases": []}, "format": "tv", "status": "airing", "startDate": "2026-07-03", "endDate": None, "datePrecision": "day",
        "primarySeason": {"year": 2026, "quarter": "summer"}, "activeSeasons": [{"year": 2026, "quarter": "summer"}], "updateWeekday": 5, "updateTime": "23:30", "timezone": "Asia/Tokyo", "episodeCount": None, "airedEpisodeCount": None,
        "isJapaneseAnime": True, "inclusionStatus": "included", "exclusionReason": None, "officialUrl": None, "coverImage": {"large": "x", "medium": None, "small": None, "source": "manual"}, "externalIds": {"bangumiSubjectId": None, "bahamutSn": None},
        "bangumi": {"subjectId": None, "url": None, "rating": None, "ratingCount": None, "rank": None, "lastSyncedAt": None}, "schedule": [episode("2026-07-03")], "staff": None, "sources": [source()], "dataStatus": "partial", "updatedAt": NOW, "createdAt": NOW,
    }
    out = copy.deepcopy(out)
    if isinstance(title, dict):
        out["title"] = title
    for key, value in fields.items():
        head, _, tail = key.partition("__")
        if tail:
            out[head][tail] = value
        else:
            out[head] = value
    return out


def bound(id_, subject, **fields):
    """An item with a subject."""
    rating = {"subjectId": subject, "url": f"https://bgm.tv/subject/{subject}", "rating": 7.5, "ratingCount": 100, "rank": 5, "lastSyncedAt": NOW}
    return item(id_, **({"bangumi": rating} | fields))


def frame(spark, items):
    from loomline import schema

    rows = [tuple([*(i[f] for f in schema.ITEM.fieldNames()), k]) for k, i in enumerate(items)]
    return spark.createDataFrame(rows, schema.T.StructType([*schema.ITEM.fields, schema.T.StructField("ordinal", schema.T.LongType())]))
