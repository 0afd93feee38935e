"""Types of the catalogue's rows.  Field names are those of the JSON files."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SEASON = struct(year=_I, quarter=_S)
SOURCE = struct(name=_S, type=_S, url=_S, retrievedAt=_S, confidence=_D, scope=_S)
TITLE = struct(original=_S, japanese=_S, chinese=_S, english=_S, aliases=T.ArrayType(_S))
COVER = struct(large=_S, medium=_S, small=_S, source=_S)
EXTERNAL = struct(bangumiSubjectId=_L, bahamutSn=_S)
RATING = struct(subjectId=_L, url=_S, rating=_D, ratingCount=_I, rank=_I, lastSyncedAt=_S)
EPISODE = struct(episodeNumber=_I, episodeTitle=_S, airDate=_S, airTime=_S, timezone=_S, status=_S, source=SOURCE, rawTimeText=_S)
STAFF = struct(studio=T.ArrayType(_S), productionCommittee=T.ArrayType(_S), originalWorkType=_S)

ITEM = struct(
    id=_S, title=TITLE, format=_S, status=_S, startDate=_S, endDate=_S, datePrecision=_S, primarySeason=SEASON, activeSeasons=T.ArrayType(SEASON),
    updateWeekday=_I, updateTime=_S, timezone=_S, episodeCount=_I, airedEpisodeCount=_I, isJapaneseAnime=_B, inclusionStatus=_S, exclusionReason=_S,
    officialUrl=_S, coverImage=COVER, externalIds=EXTERNAL, bangumi=RATING, schedule=T.ArrayType(EPISODE), staff=STAFF, sources=T.ArrayType(SOURCE),
    dataStatus=_S, updatedAt=_S, createdAt=_S,
)
LIBRARY = struct(schemaVersion=_I, updatedAt=_S, generatedBy=_S, items=T.ArrayType(ITEM))

BAG = T.ArrayType(struct(key=_S, value=_S))
SUBJECT = struct(
    id=_L, type=_I, name=_S, name_cn=_S, summary=_S, date=_S, platform=_S, images=struct(large=_S, common=_S, medium=_S, small=_S, grid=_S), eps=_I, total_episodes=_I,
    rating=struct(score=_D, total=_I, rank=_I), rank=_I, infobox=BAG, tags=T.ArrayType(struct(name=_S, count=_I, total_count=_I)), nsfw=_B,
)
SUBJECT_EPISODE = struct(id=_L, sort=_D, ep=_D, name=_S, name_cn=_S, airdate=_S, subject_id=_L, type=_I)

ISSUE = struct(path=_S, code=_S, message=_S, severity=_S)
SOURCE_ISSUE = struct(source=_S, code=_S, message=_S, retryable=_B, status=_I, details=_S)
OVERRIDE = struct(id=_S, beijingDate=_S, beijingTime=_S, sourceName=_S, sourceUrl=_S, note=_S)
STATUS = struct(
    schemaVersion=_I, status=_S, lastSuccessAt=_S, lastAttemptAt=_S, lastError=struct(code=_S, message=_S, at=_S),
    currentJob=struct(jobId=_S, year=_I, season=_I, quarter=_S, startedAt=_S), cache=struct(animeUpdatedAt=_S, itemCount=_I),
)

#: Members of the enumerations.
QUARTERS = ("winter", "spring", "summer", "fall")
FORMATS = ("tv", "web", "movie", "ova", "sp", "recap", "pv", "cm", "music_video", "unknown")
STATUSES = ("announced", "airing", "finished", "delayed", "cancelled", "unknown")
DATA_STATUSES = ("complete", "partial", "conflicting", "unverified")
INCLUSIONS = ("included", "optional", "needs_review", "excluded")
SOURCE_TYPES = ("official", "tv_station", "streaming_platform", "bangumi", "third_party", "ai_inferred", "manual")
SCHEDULE_STATUSES = ("confirmed", "tentative", "changed", "delayed", "unknown")
TIMEZONES = ("Asia/Tokyo", "Asia/Shanghai")
GENERATORS = ("manual-update", "manual-edit", "migration")
