"""Tunables, all in one place."""

# Windows and limits that decide results.
FIRST_READ_DAYS, OVERLAP_DAYS = 30, 7
MERGE_DAYS, WEAK_DUPLICATE_DAYS = 7, 3
LEAST_FINGERPRINT_CHARS = 200
SILENCE_DAYS = 7
FORMAT_LAST, FORMAT_LEAST, FORMAT_SHARE = 20, 10, 0.5
REMINDER_DAYS = 3
ADMISSION_DAYS, OPEN_WITHOUT_DEADLINE_DAYS = 3, 7
DEADLINE_DAYS_BEFORE, DEADLINE_DAYS_AFTER = 10, 60
DATE_DISTANCE, HOUR_DISTANCE = 60, 20
DAY_END = (23, 59, 59)
LETTERHEAD_LINES, SUBJECT_REGION_LINES, SUBJECT_CONTINUATION_LINES = 15, 8, 6
LEAST_TEXT_CHARS = 50
PAGE_CHARS, FOLLOWING_CHARS, LAST_FOLLOWING_PAGE = 4000, 16000, 5
MOST_PART_BYTES, ARCHIVE_DEPTH = 50 * 1024 * 1024, 2
CHECK_DAYS = 30
HTTP_SPACING_S, HTTP_ATTEMPTS, HTTP_BACKOFF_S, HTTP_TIMEOUT_S = 1.0, 4, 2.0, 30.0
ZONE = "Europe/Rome"
