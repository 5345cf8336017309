"""Schemas of the tables; readers enforce them and never infer."""

from __future__ import annotations

#: The import dataset: one JSON object with four arrays of records.
IMPORT = """
communities array<struct<vkId:int, name:string, screenName:string, membersCount:int, isClosed:boolean, type:string>>,
authors array<struct<vkId:int, firstName:string, lastName:string, screenName:string, followersCount:int, isClosed:boolean>>,
posts array<struct<vkId:int, ownerId:int, fromId:int, date:bigint, text:string, likes:int, reposts:int, comments:int, views:int,
  containsMedia:boolean, hasCopyHistory:boolean, window:string>>,
comments array<struct<vkId:int, postVkId:int, postOwnerId:int, fromId:int, date:bigint, text:string, likes:int>>
"""

#: A corpus with ground truth.
CORPUS = """
version string, description string, sha256 string,
authors array<struct<id:int, vk_id_hashed:string, followers_count:int, is_closed:boolean, discovery_source:string>>,
posts array<struct<id:int, from_id:int, published_at:bigint, text_clean:string, likes:int, reposts:int, comments:int, own_text_length:int,
  has_copy_history:boolean, contains_media:boolean, ground_truth:struct<is_topic_relevant:boolean, sentiment:string, originality_type:string>>>,
ground_truth_roles array<struct<author_id:int, expected_role:string>>,
ground_truth_anomalies array<struct<date:string, expected_types array<string>>>
""".replace("expected_types array", "expected_types:array")

#: A post as the remote interface returns it.
REMOTE_POST = """
id int, owner_id int, from_id int, date bigint, text string, likes struct<count:int>, reposts struct<count:int>, comments struct<count:int>,
views struct<count:int>, attachments array<struct<type:string>>, copy_history array<struct<id:int>>
"""

SESSION = """
id int, name string, topic_query string, primary_ngrams string, secondary_ngrams string, excluded_ngrams string, reference_texts string,
baseline_days int, current_days int, nlp_mode string, status string, session_family_id int, created_at timestamp, deleted_at timestamp
"""
