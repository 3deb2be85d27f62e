"""Fixed values, written down apart from the code that uses them; the check SQL takes its lists from there."""

from postaudit import schema as S
from postaudit.functions import responses as R


def test_phrases():
    assert S.CASCADE_THREAT == ["kill yourself", "kys", "go die", "should die", "i'll kill you", "going to kill", "threaten to"]
    assert S.CASCADE_HATE == ["deserves to die", "should be killed"]
    assert S.RULE_ABUSIVE == ["stupid", "idiot", "moron", "retard", "dumbass", "asshole", "fuck you", "fuck off",
                              "go to hell", "kill yourself", "kys", "you're a", "you are a"]
    assert S.RULE_HATE == ["i hate", "i despise", "i loathe", "all [group] are", "every [group] is", "should die",
                           "deserves to die", "should be killed"]
    assert S.RULE_THREAT == ["i'll kill", "i will kill", "going to kill", "i'll hurt", "i will hurt", "going to hurt",
                             "threaten", "threatening"]


def test_messages():
    assert (S.REASON_BLOCKED, S.REASON_CASCADE_THREAT, S.REASON_CASCADE_HATE) == (
        "Contains blocked phrase: ", "Contains threatening language", "Contains hate speech patterns")
    assert (S.REASON_RULE_ABUSIVE, S.REASON_RULE_HATE, S.REASON_RULE_THREAT, S.REASON_CLEAN) == (
        "Contains abusive or offensive language", "Contains hate speech or violent language",
        "Contains threats or violent language", "No issues detected")
    assert (S.SCORER_REASON, S.POST_URL_BASE, S.ZIP_MAGIC_HEX) == (
        "llm_scorer", "https://twitter.com/i/web/status/", "504B0304")
    assert (S.ERROR_NO_MEMBER, S.ERROR_ZIP, S.ERROR_JSON, S.ERROR_PREFIX) == (
        "no tweet.js or tweets.js file found in ZIP archive", "failed to open ZIP archive", "failed to parse JSON",
        "failed to parse archive: ")
    assert (R.BAD_FORMAT, R.BAD_VERDICT) == ("invalid response format: ", "failed to parse JSON response")
