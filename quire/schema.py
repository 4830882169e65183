"""Schemas of the entities. Ids are longs, times are UTC timestamps, metadata with known keys are structs."""

from pyspark.sql import types as T

_of = T._parse_datatype_string

DOCUMENT_STATUS = ("pending", "processing", "completed", "failed", "deleting", "deleted")

DUPLICATE_GROUPS = _of("group_id long, hash_algo string, content_hash string, created_at timestamp")
DOCUMENTS = _of(
    "doc_id long, group_id long, content_hash string, byte_size long, filename string, source_uri string, dpi int, status string, "
    "created_at timestamp, updated_at timestamp, meta struct<ingestion_mode:int,duplicate_group_id:long,duplicate_status:string,"
    "duplicate_of_document_id:long,input_kind:string,stages:map<string,struct<status:string,detail:string>>>, declared_langs array<string>, "
    "detected_langs map<string,double>, primary_lang string, primary_script string, sourcetype string"
)
PAGES = _of(
    "page_id long, doc_id long, page_number int, width int, height int, dpi int, lang_probs map<string,double>, primary_lang string, "
    "primary_script string, sourcetype string, meta map<string,string>, text_layer string, md_uri string, markdown string"
)
PAGE_BLOCKS = _of(
    "block_id long, page_id long, block_index int, reading_order int, category string, bbox array<int>, text string, engine string, extra map<string,string>"
)
PAGE_MT = _of("page_mt_id long, page_id long, lang string, text string, uri string, translated_at timestamp, model string")
BLOCK_MT = _of("block_mt_id long, block_id long, lang string, text string, translated_at timestamp, model string")
IMAGES = _of("image_id long, page_id long, filename string, uri string, data binary")
ENTITIES = _of("entity_id long, doc_id long, label string, text string, start int, end int")
JOBS = _of("job_id string, doc_id long, stage string, status string, events array<struct<ts:timestamp,level:string,stage:string,message:string,data:string>>")
