"""Schemas of the records that the library reads and writes, as DDL (parsing it takes a session)."""

import json

from pyspark.sql.types import StructType

PAGE = "content string, metadata struct<url:string,title:string,scraped_at:string,content_length:bigint,section:string>, html string"
POST = (
    "content string, metadata struct<title:string,url:string,published:string,updated:string,author:string,categories:array<string>,"
    "summary:string,fetched_at:string,source:string>, processing struct<content_length:bigint,word_count:bigint,is_relevant:boolean>"
)
FEED_ENTRY = "title string, link string, summary string, published string, updated string, author string, tags array<struct<term:string>>"
SEGMENT = "id int, start double, `end` double, text string, speaker string"
TRANSCRIPT = "title string, video_id string, url string, transcript string, full_text string, segments array<struct<id:int,start:double,`end`:double,text:string,speaker:string>>"
CLEANED = (
    "content string, metadata struct<url:string,title:string,scraped_at:string,content_length:bigint,section:string>, "
    "processing struct<original_length:bigint,cleaned_length:bigint,cleaned_at:string,processor:string,word_count:bigint>"
)
CHUNK = (
    "chunk_id string, content string, metadata struct<url:string,title:string,chunk_index:int,total_chunks:int,chunk_method:string,"
    "chunk_size:int,chunk_overlap:int>, processing struct<chunked_at:string,estimated_tokens:int,character_count:int,word_count:int>"
)

#: The fields that a transcript and each of its segments must have.
REQUIRED = ("title", "video_id", "segments")
REQUIRED_IN_SEGMENT = ("id", "start", "end", "text")


def parsed(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def saved(schema: StructType) -> str:
    return schema.json()


def loaded(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))
