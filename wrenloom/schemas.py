"""Schemas of the tables, as DDL, and the values of the enumerated columns. No schema is ever inferred."""

from __future__ import annotations

PENDING, PROCESSING, SUCCESS, FAILED = 0, 1, 2, 3
STARTED, ENDED, WORKER_STOPPED = 0, 1, 2

TASKS = "id bigint, pid bigint, stage string, url string, title string, content string, retry int, status int, repeatable int, `repeat` int, error string, created_at timestamp, updated_at timestamp"
SUBMISSIONS = "submit_seq bigint, id bigint, pid bigint, url string, retry int, stage string, repeatable boolean"
STAGES = "stage string, worker_count int, queue_size int, delay_ns bigint, max_attempts int, backoff_ns bigint"
JOBS = "name string, type string, schedule string, args map<string,string>"
ACTIVITIES = "stage string, seq bigint, type int, worker_id bigint, url string, start_time timestamp, end_time timestamp, duration_ns bigint, error string"
LOG = "component string, ts timestamp, message string"
PLAYLISTS = "playlist_id bigint, base_url string, text string"
PLAYLIST_STATE = "playlist_url string, output_file string, total_segments int, completed array<int>, segment_files array<string>"
FILE_STATE = "url string, output_file string, total_size bigint, completed array<bigint>, chunk_size bigint, temp_files array<string>"
PROXIES = "position int, host string, port string"
DETAIL = "cover string, cover_url string, title string, author string, tags array<string>, series_info struct<series:map<string,string>,download:map<string,boolean>>"
VIDEO = "dir string, source string"
RESPONSES = "url string, status int, headers map<string,string>, body binary, error string"
