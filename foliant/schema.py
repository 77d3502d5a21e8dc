"""Explicit schemas of the engine's tables."""

from __future__ import annotations

CORRECTIONS = (
    "subject string, original string, corrected string, confidence double, frequency bigint, source string, "
    "book_title string, pages array<int>, first_seen timestamp, last_seen timestamp"
)
FEEDBACK = (
    "event_id bigint, ts timestamp, subject string, book_title string, page int, original string, edited string, source string"
)
OCR_WORDS = "doc_id bigint, page_no int, block_num int, par_num int, line_num int, word_idx int, text string, conf int"
LAYOUT_BLOCKS = (
    "doc_id bigint, page_no int, block_idx int, x0 double, y0 double, x1 double, y1 double, text string, "
    "page_w double, page_h double, n_images int, n_drawings int"
)
OCR_VARIANTS = "doc_id bigint, variant int, text string"
PAGE_PAIRS = "doc_id bigint, page int, ocr_text string, reference_text string"
TERM_FIXES = "wrong string, right string"
LEXICON = "term string, subject string"
GOLDEN = "id string, input_text string, expected_output string, error_class string"
