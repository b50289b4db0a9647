"""Schemas of assets, vectors and results."""

REGION = "struct<region_id:string,bbox:array<double>,objects:array<struct<label:string,confidence:double,bbox:array<double>>>,scene:struct<caption:string,tags:array<string>>,visual_input:string,visual:array<float>,clip:array<float>>"
PAGE = f"struct<page_index:int,page_type:string,text:string,text_input:string,text_vector:array<float>,regions:array<{REGION}>>"
ASSETS = (
    "asset_id string, path string, kind string, sha256 string, pixel_hash string, phash string, phash64 bigint, size_bytes bigint,"
    " resolution struct<width:int,height:int>, n_pages int, format string, indexed boolean, state string, updated_at timestamp,"
    " objects array<struct<label:string,confidence:double,bbox:array<double>>>,"
    " faces array<struct<face_id:string,embedding:array<float>,bbox:array<double>,confidence:double>>,"
    " scene struct<caption:string,tags:array<string>>, ocr struct<full_text:string,text_blocks:array<string>,has_text:boolean>,"
    " embeddings struct<visual:array<float>,text:array<float>,clip:array<float>,visual_input:string,text_input:string,model:string>,"
    f" pages array<{PAGE}>, models_used map<string,string>, version string"
)
VECTORS = "space string, vec_id string, asset_id string, page_index int, region_index int, embedding array<float>"
SPACES = ("visual", "text", "clip")
VERSION = "0.2"
