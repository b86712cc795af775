"""Row schemas of requests, tensors and results."""

from __future__ import annotations

from pyspark.sql import types as T

LETTERBOX = T._parse_datatype_string("struct<scale:float,pad_left:int,pad_top:int,orig_w:int,orig_h:int>")
TENSOR = T._parse_datatype_string("struct<data:array<float>,shape:array<bigint>>")
MODEL_OUTPUT = T.MapType(T.StringType(), TENSOR)
DETECTION = T._parse_datatype_string("struct<x:int,y:int,w:int,h:int,score:float,class_id:int>")
DETECTIONS = T.ArrayType(DETECTION)
IMAGE = T._parse_datatype_string("struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
REQUEST = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("image", IMAGE), T.StructField("ts", T.TimestampType())])
LATENCY_SAMPLE = T._parse_datatype_string("struct<mode:string,clients:int,client_id:int,latency_ms:double>")
PERCENTILES = ("p50", "p90", "p95", "p99")
RESULT = T._parse_datatype_string(
    "struct<mode:string,override_batch:int,total_requests:bigint,wall_time_ms:double,throughput_qps:double,latency_avg_ms:double,latency_min_ms:double,latency_max_ms:double,"
    + ",".join(f"latency_{p}_ms:double" for p in PERCENTILES) + ">"
)
LABEL = T._parse_datatype_string("struct<class_id:int,label:string>")

#: Input and output of each runner: detection is one to many, the others one to one.
RUNNERS = {"detect": (IMAGE, DETECTIONS), "classify": (IMAGE, T.IntegerType()), "restore": (IMAGE, IMAGE)}
