"""The evaluation prompt of one post under its job's criteria."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every text of the prompt, in order of appearance.
INTRO = "You are a content moderation assistant. Evaluate this tweet based on the provided criteria.\n\nTweet posted on: "
TEXT_OPEN = '\nTweet text: "'
FLAG_OPEN = '"\n\nMODERATION CRITERIA:\nFlag tweets that contain:\n   '
EXCLUDE_OPEN = "\n\nDO NOT flag tweets that are:\n   "
OUTRO = """

3. Consider context - a tweet saying "I hate Mondays" is NOT hate speech unless it targets a specific group.

Examples:
Tweet: "I hate Mondays"
Response: {"should_flag": false, "score": 0.0, "reason": "Not hate speech, just expressing frustration", "labels": []}

Tweet: "All [group] should die"
Response: {"should_flag": true, "score": 0.95, "reason": "Hate speech targeting a group", "labels": ["hate_speech"]}

Now evaluate the tweet above based on the criteria. Respond ONLY with valid JSON, no other text:
{
  "should_flag": true/false,
  "score": 0.0-1.0,
  "reason": "brief explanation",
  "labels": ["abusive", "threatening", etc.]
}"""
BULLET_SEPARATOR = "\n   "
FLAG_LINES = {
    "exclude_threats": "- Threats of violence or harm",
    "exclude_hate_speech": "- Hate speech or discrimination targeting groups",
    "exclude_harassment": "- Harassment or targeted abuse",
    "exclude_profanity": "- Severe profanity used aggressively",
    "professional_check": "- Unprofessional language or tone",
    "exclude_politics": "- Political content or statements",
}
FLAG_WORDS = "- Contains forbidden words/phrases: "
FLAG_NONE = "None specified"
EXCLUDE_ALWAYS = [
    "- Simply old (age alone is not a reason)",
    "- Contain mild language or jokes",
    "- Express opinions you disagree with (unless they violate other criteria)",
    "- Are sarcastic or self-deprecating",
]
EXCLUDE_UNLESS = {
    "exclude_profanity": "- Use profanity in non-aggressive contexts",
    "exclude_politics": "- Express political opinions (unless they violate other criteria)",
}
TONE_OPEN = "\n4. Expected tone: "
TONE_CLOSE = ". Flag tweets that significantly deviate from this tone."


def long_date(ts: Column) -> Column:
    return F.date_format(ts, "MMMM d, yyyy")


def escape_text(text: Column) -> Column:
    return F.translate(F.replace(text, F.lit('"'), F.lit('\\"')), "\n\r", "  ")


def flag_section(criteria: Column) -> Column:
    lines = [F.when(criteria[name], line) for name, line in FLAG_LINES.items()]
    words = criteria["forbidden_words"]
    lines.append(F.when(F.size(words) > 0, F.concat(F.lit(FLAG_WORDS), F.array_join(words, ", "))))
    return F.coalesce(F.nullif(F.concat_ws(BULLET_SEPARATOR, *lines), F.lit("")), F.lit(FLAG_NONE))


def exclude_section(criteria: Column) -> Column:
    lines = [F.lit(line) for line in EXCLUDE_ALWAYS]
    lines += [F.when(~criteria[name], line) for name, line in EXCLUDE_UNLESS.items()]
    return F.concat_ws(BULLET_SEPARATOR, *lines)


def build_prompt(text: Column, created_at: Column, criteria: Column) -> Column:
    """`criteria` must be filled, see criteria_or_default."""
    tone = F.when(criteria["tone"] != "", F.concat(F.lit(TONE_OPEN), criteria["tone"], F.lit(TONE_CLOSE)))
    return F.concat(
        F.lit(INTRO), long_date(created_at),
        F.lit(TEXT_OPEN), escape_text(text),
        F.lit(FLAG_OPEN), flag_section(criteria),
        F.lit(EXCLUDE_OPEN), exclude_section(criteria),
        F.lit("\n"), F.coalesce(tone, F.lit("")),
        F.lit(OUTRO),
    )
