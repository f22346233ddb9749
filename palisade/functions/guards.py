"""Input guard, grounding, hallucination and output guard as struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import emergency, fixed, text
from palisade.functions.patterns import any_of, let, matches


def _on(flag: Column | bool) -> Column:
    return F.lit(flag) if isinstance(flag, bool) else flag


def injection_reason(t: Column) -> Column:
    """Reason of the first injection rule that matches; null if none does."""
    return F.coalesce(*(F.when(matches(t, p, multiline=p.endswith(r"^\s*system\s*:)")), F.lit(r)) for p, r in fixed.INJECTION_RULES))


def harmful_reason(t: Column) -> Column:
    return F.when(any_of(t, fixed.HARMFUL_PATTERNS), F.lit(fixed.HARMFUL_REASON))


def toxicity_reason(t: Column) -> Column:
    return F.when(any_of(t, fixed.TOXICITY_PATTERNS), F.lit(fixed.TOXICITY_REASON))


def input_guard(t: Column, enabled: Column | bool = True, emergency_enabled: Column | bool = True) -> Column:
    """``struct<is_safe, blocked_reason, emergency, sanitized_text>``.

    Disabled: the text passes as it is, and no emergency is looked for. Else a
    critical emergency, an injection and harmful intent block, in this order; an
    emergency that is not critical is attached. Checks see the raw text; every
    enabled branch carries the sanitised one. Null text gives null.
    """

    def result(safe: Column, reason: Column, found: Column, clean: Column) -> Column:
        return F.struct(safe.alias("is_safe"), reason.cast("string").alias("blocked_reason"), found.alias("emergency"), clean.alias("sanitized_text"))

    nothing = F.lit(None).cast(emergency.RESULT)

    def judged(e: Column) -> Column:
        reason = F.when(e["severity"] == "critical", F.lit(fixed.CRITICAL_REASON)).otherwise(F.coalesce(injection_reason(t), harmful_reason(t)))
        attached = F.when(e["is_emergency"], e)
        return let(reason, lambda r: result(r.isNull(), r, attached, text.sanitize(t)))

    checked = let(emergency.detect(t, emergency_enabled), judged)
    return F.when(t.isNotNull(), F.when(_on(enabled), checked).otherwise(result(F.lit(True), F.lit(None), nothing, t)))


def claims(output: Column) -> Column:
    """Sentences with at least one content token, stripped, in order."""
    parts = F.transform(F.split(output, fixed.CLAIM_SEPARATORS, -1), text.strip)
    return F.filter(parts, lambda c: F.size(text.content_tokens(c)) > 0)


def context_tokens(context: Column) -> Column:
    """Different content tokens of an array of passages."""
    return text.token_set(F.array_join(context, " "))


def is_grounded(claim: Column, known: Column) -> Column:
    """At least half of a claim's different tokens are known."""
    return let(text.token_set(claim), lambda c: F.size(F.array_intersect(c, known)) * 2 >= F.size(c))


def verdict(score: Column, threshold: Column | float) -> Column:
    limit = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return F.when(score < limit / 2, "grounded").when(score < limit, "partial").otherwise("hallucinated")


def hallucination(output: Column, context: Column, threshold: Column | float = 0.7, known: Column | None = None) -> Column:
    """``struct<score, grounded_claims, ungrounded_claims, verdict, n_ungrounded, n_claims>``.

    The score is the share of claims that are not grounded, to four digits: 0
    without claims, 1 for claims without any passage. The counts that make it
    are given beside it, as halves at the fifth digit round to even here.
    ``known``, if given, has the output's tokens that the passages have; then only
    the number of passages is read of ``context``.
    """

    def split(known: Column) -> Column:
        def parts(all_claims: Column) -> Column:
            some = F.size(context) > 0
            # the passages' tokens are many: they are looked through once, for those of all claims
            own = F.array_distinct(F.flatten(F.transform(all_claims, text.token_set)))
            marked = let(F.array_intersect(own, known), lambda hit: F.transform(all_claims, lambda c: some & is_grounded(c, hit)))
            good = lambda ok: F.filter(all_claims, lambda c, i: F.get(ok, i))
            bad = lambda ok: F.filter(all_claims, lambda c, i: ~F.get(ok, i))

            def scored(u: Column, g: Column) -> Column:
                score = F.when(F.size(all_claims) == 0, F.lit(0.0)).otherwise(F.bround(F.size(u) / F.size(all_claims), 4))
                return let(score, lambda s: F.struct(
                    s.alias("score"), g.alias("grounded_claims"), u.alias("ungrounded_claims"), verdict(s, threshold).alias("verdict"),
                    F.size(u).cast("long").alias("n_ungrounded"), F.size(all_claims).cast("long").alias("n_claims"),
                ))

            return let(marked, lambda ok: let(bad(ok), lambda u: scored(u, good(ok))))

        return let(claims(output), parts)

    return F.when(output.isNotNull(), let(context_tokens(context) if known is None else known, split))


def confidence(output: Column, context: Column, known: Column | None = None) -> Column:
    """Share of the output's different tokens that the passages have, to four digits; 1 without passages or tokens. ``known`` as in ``hallucination``."""

    def share(own: Column) -> Column:
        hits = F.size(F.array_intersect(own, context_tokens(context) if known is None else known))
        return F.when((F.size(context) == 0) | (F.size(own) == 0), F.lit(1.0)).otherwise(F.bround(hits / F.size(own), 4))

    return F.when(output.isNotNull(), let(text.token_set(output), share))


def with_disclaimers(output: Column, query: Column) -> Column:
    """The output with the disclaimers of the domains that it or the query touches, unless it has one already."""
    both = F.concat_ws("\n", query, output)
    wanted = F.array_compact(F.array(*(F.when(matches(both, p), F.lit(fixed.DISCLAIMERS[d])) for d, p in fixed.DOMAIN_PATTERNS.items())))
    added = let(wanted, lambda w: F.when(F.size(w) == 0, output).otherwise(F.concat_ws("\n\n", text.strip_end(output), F.array_join(w, "\n\n"))))
    return F.when(matches(output, fixed.DISCLAIMER_MARKER), output).otherwise(added)


#: How the doubles halfway between two hundredths print, which depends on their binary digits.
_HALVES = [f"{k / 1000:.2f}" for k in range(5, 1000, 10)]


def two_digits(score: Column) -> Column:
    """A score of at most four digits, from 0 to 1, printed with two, rounded by its exact binary value."""
    parts = F.round(score * 10000).cast("int")
    half = F.get(F.array(*map(F.lit, _HALVES)), F.floor(parts / 100).cast("int"))
    return F.when(parts % 100 == 50, half).otherwise(F.format_string("%.2f", score))


def output_guard(output: Column, query: Column, context: Column, threshold: Column | float = 0.7, enabled: Column | bool = True, known: Column | None = None) -> Column:
    """``struct<is_safe, blocked_reason, sanitized_output, confidence_score, warnings>``.

    Disabled: the output passes with confidence 1. Toxic output is blocked with
    an empty text, confidence 0 and no warnings. Else grounding is measured on
    the raw output, personal data is redacted, and disclaimers are added.
    ``known`` as in ``hallucination``.
    """
    fixed_limit = isinstance(threshold, (int, float))
    limit = F.lit(float(threshold)) if fixed_limit else threshold
    printed = F.lit(f"{threshold:.2f}") if fixed_limit else two_digits(threshold)
    none = F.array().cast("array<string>")

    def result(safe, reason, clean: Column, score: Column, warnings: Column) -> Column:
        return F.struct(
            F.lit(safe).alias("is_safe"), F.lit(reason).cast("string").alias("blocked_reason"), clean.alias("sanitized_output"), score.alias("confidence_score"), warnings.alias("warnings")
        )

    def checked(score: Column) -> Column:
        weak = F.when(
            (F.size(context) > 0) & (score < limit),
            F.format_string("Low grounding: the response may not be fully supported by the retrieved context (score %s < threshold %s).", two_digits(score), printed),
        )
        leak = let(text.pii_kinds(output), lambda k: F.when(F.size(k) > 0, F.concat(F.lit("Redacted potential PII leaked into the output: "), F.array_join(k, ", "), F.lit("."))))
        clean = with_disclaimers(text.redact(output), query)
        return result(True, None, clean, score, F.array_compact(F.array(weak, leak)))

    blocked = result(False, fixed.TOXICITY_REASON, F.lit(""), F.lit(0.0), none)
    judged = F.when(toxicity_reason(output).isNotNull(), blocked).otherwise(let(confidence(output, context, known), checked))
    return F.when(output.isNotNull(), F.when(_on(enabled), judged).otherwise(result(True, None, output, F.lit(1.0), none)))
