"""Schemas of the pipeline's records (DDL strings, readable by every reader)."""

# Upload notification, one JSON document holding a Records array.
UPLOAD_NOTIFICATION = (
    "Records array<struct<"
    "eventVersion: string, eventSource: string, awsRegion: string, eventTime: string, "
    "eventName: string, userIdentity: struct<principalId: string>, "
    "requestParameters: struct<sourceIPAddress: string>, "
    "responseElements: map<string,string>, "
    "s3: struct<s3SchemaVersion: string, configurationId: string, "
    "bucket: struct<name: string, ownerIdentity: struct<principalId: string>, arn: string>, "
    "object: struct<key: string, size: bigint, eTag: string, sequencer: string>>>>"
)

# Audit-log upload event.
AUDIT_EVENT = (
    "source string, `detail-type` string, time string, "
    "detail struct<eventSource: string, eventName: string, "
    "requestParameters: struct<bucketName: string, key: string>>"
)

# Normalised upload row produced by both readers.
UPLOAD = "bucket string, raw_key string, event_name string, event_time string, size bigint"

# D3: object metadata manifest.
MANIFEST = "bucket string, key string, content_type string"

# One TMX translation unit.
TMX_UNIT = "tuv array<struct<`_xml:lang`: string, seg: string>>"

# Translation-memory record as stored by the TM sink.
TM_RECORD = (
    "tm_id bigint, source_text string, target_text string, translation string, "
    "score double, embedding array<double>, source_lang string, target_lang string"
)

# Hit rows from the similarity search.
HIT = "query_id bigint, tm_id bigint, score double, rank int"
