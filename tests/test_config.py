"""Configuration: defaults, environment, flag parsing, sender rule, merge."""

import pytest

from tmweave.config import Features, ModelConfig, default_config, load_config


def test_defaults():
    c = default_config({})
    assert c.tmx_bucket == "translation-memory-tmx"
    assert c.documents_bucket == "translation-memory-docs"
    assert c.models.embedding_model == "amazon.titan-embed-text-v1"
    assert c.models.translation_model == "anthropic.claude-v2"
    assert c.search.collection_name == "translation-memory"
    assert c.features.email_notifications is False
    assert c.sender_email is None


def test_environment_overrides():
    env = {"TMX_BUCKET_NAME": "custom-tmx-bucket", "DOCUMENTS_BUCKET_NAME": "custom-docs-bucket",
           "BEDROCK_EMBEDDING_MODEL": "custom-embedding-model",
           "BEDROCK_TRANSLATION_MODEL": "custom-translation-model",
           "OPENSEARCH_COLLECTION_NAME": "custom-opensearch-collection",
           "ENABLE_EMAIL_NOTIFICATIONS": "true", "SENDER_EMAIL": "custom@example.com"}
    c = default_config(env)
    assert (c.tmx_bucket, c.documents_bucket) == ("custom-tmx-bucket", "custom-docs-bucket")
    assert c.models == ModelConfig("custom-embedding-model", "custom-translation-model")
    assert c.search.collection_name == "custom-opensearch-collection"
    assert c.features.email_notifications is True
    assert c.sender_email == "custom@example.com"


@pytest.mark.parametrize("value,expected", [("true", True), ("false", False),
                                            ("not-a-boolean", False), ("TRUE", False)])
def test_flag_only_exact_true(value, expected):
    assert default_config({"ENABLE_EMAIL_NOTIFICATIONS": value}).features.email_notifications is expected


def test_flag_without_sender_is_an_error():
    with pytest.raises(ValueError, match="SENDER_EMAIL must be provided"):
        load_config(env={"ENABLE_EMAIL_NOTIFICATIONS": "true"})


def test_shallow_merge_replaces_whole_group():
    c = load_config({"models": ModelConfig(embedding_model="e2")}, env={})
    assert c.models.embedding_model == "e2"
    assert c.models.translation_model == "anthropic.claude-v2"
    c2 = load_config({"features": Features(True), "sender_email": "a@b.c"}, env={})
    assert c2.notifications_enabled


def test_partial_group_drops_the_environments_values():
    env = {"BEDROCK_TRANSLATION_MODEL": "from-env", "BEDROCK_EMBEDDING_MODEL": "from-env"}
    c = load_config({"models": {"embedding_model": "e"}}, env=env)
    assert c.models == ModelConfig("e", "anthropic.claude-v2")


def test_ship_package_adds_an_importable_archive(spark):
    import zipfile

    from tmweave.session import ship_package

    archive = ship_package(spark)
    names = zipfile.ZipFile(archive).namelist()
    assert "tmweave/__init__.py" in names and "tmweave/operators/vectors.py" in names

    def probe(_):
        import tmweave.config as c
        return [c.DEFAULT_COLLECTION]

    assert spark.sparkContext.parallelize([0], 1).mapPartitions(probe).collect() == ["translation-memory"]
