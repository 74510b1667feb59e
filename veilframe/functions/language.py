"""Language guess, answer instructions, platform and vendor names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.rules.model import java_regex

# Word lists and texts.
DEVANAGARI = "[ऀ-ॿ]"
MARATHI_LETTERS = "[ळिीआहेतहाहोतेखातरलॉगिन]"
MARATHI_WORDS = "(?i)(?:आहे|नाही|झाला|केला|tapaasa|zhala)"
ROMAN_HINDI = ("(?i)(?:karo|kare|karte|waqt|ho|gaya|hai|raha|naam|mera|apna|tapaasa|zhala|ahe|"
               "krupaya)")
ROMAN_MARATHI = "(?i)(?:zhala|ahe|krupaya|tapaasa|mhnun)"
GATEWAY_INSTRUCTIONS = {
    "hi": "\n\n[LANGUAGE & REASONING INSTRUCTION]: Respond in natural, conversational Hindi "
          "(Devanagari script or clean Hinglish depending on context). Maintain technical terms "
          "like API, Server, Database, Key, Redaction, SSL, SQL Query, etc., in English/Hinglish "
          "jargon. Ensure explanations hit the core logical meaning without robotic word-for-word "
          'translation (e.g. use "Database connect karte waqt timeout ho gaya hai" instead of '
          "literal word translations). DO NOT translate or alter redaction tokens like "
          "[SECRET_KEY_REDACTED_1] or [SSN_REDACTED_1].",
    "mr": "\n\n[LANGUAGE & REASONING INSTRUCTION]: Respond in natural, conversational Marathi. "
          "Maintain technical terms like API, Server, Database, Code, Redaction, SSL, Query, "
          "etc., in English/Marathi technical jargon. Ensure explanations are clear, natural, and "
          'logical (e.g. "Database connection timeout zhala ahe, krupaya server configurations '
          'tapaasa"). DO NOT translate or alter redaction tokens like [SECRET_KEY_REDACTED_1] or '
          "[SSN_REDACTED_1].",
    "en": "\n\n[LANGUAGE & REASONING INSTRUCTION]: Respond in clear, professional English. "
          "Maintain technical terms. DO NOT translate or alter redaction tokens like "
          "[SECRET_KEY_REDACTED_1] or [SSN_REDACTED_1].",
}
SERVER_INSTRUCTIONS = {
    "hi": "[LANGUAGE & REASONING INSTRUCTION]: Respond in natural, conversational Hindi "
          "(Devanagari script or clean Hinglish depending on context). Maintain technical terms "
          "like API, Server, Database, Key, Redaction in English/Hinglish jargon. DO NOT "
          "translate or alter redaction tokens like [REDACTED_AADHAAR_1] or [REDACTED_API_KEY_1].",
    "mr": "[LANGUAGE & REASONING INSTRUCTION]: Respond in natural, conversational Marathi. "
          "Maintain technical terms like API, Server, Database, Code, Redaction in "
          "English/Marathi technical jargon. DO NOT translate or alter redaction tokens like "
          "[REDACTED_AADHAAR_1] or [REDACTED_API_KEY_1].",
    "en": "[LANGUAGE & REASONING INSTRUCTION]: Respond in clear, professional English. Maintain "
          "technical terms. DO NOT translate or alter redaction tokens like [REDACTED_AADHAAR_1] "
          "or [REDACTED_API_KEY_1].",
}


def guess_language(text: Column, override: Column | None = None) -> Column:
    """en, hi or mr from an explicit choice, the script, or romanised keywords."""
    hindi = java_regex(ROMAN_HINDI, "word", "word")
    marathi = java_regex(ROMAN_MARATHI, "word", "word")
    guessed = (
        F.when(text.rlike(DEVANAGARI),
               F.when(text.rlike(MARATHI_LETTERS) & text.rlike(MARATHI_WORDS), "mr")
               .otherwise("hi"))
        .when(text.rlike(hindi), F.when(text.rlike(marathi), "mr").otherwise("hi"))
        .otherwise("en"))
    if override is None:
        return guessed
    return F.when(override.isin("en", "hi", "mr"), override).otherwise(guessed)


def script_language(text: Column) -> Column:
    """hi when any Devanagari letter occurs, else en."""
    return F.when(text.rlike(DEVANAGARI), "hi").otherwise("en")


def with_instruction(df: DataFrame, language: str = "language", wording: str = "gateway",
                     out: str = "language_instruction") -> DataFrame:
    """Join the instruction of each row's language; unknown languages get English.

    The dimension has three constant rows, so broadcasting it is safe at any scale.
    """
    texts = GATEWAY_INSTRUCTIONS if wording == "gateway" else SERVER_INSTRUCTIONS
    dim = df.sparkSession.createDataFrame(
        list(texts.items()), f"_lang string, {out} string")
    known = F.when(F.col(language).isin(*texts), F.col(language)).otherwise("en")
    return (df.withColumn("_lang", known)
            .join(F.broadcast(dim), "_lang", "left").drop("_lang"))


def platform_of(host: Column) -> Column:
    return (F.when(host.contains("openai") | host.contains("chatgpt"), "ChatGPT")
            .when(host.contains("claude"), "Claude")
            .when(host.contains("google") | host.contains("gemini"), "Gemini")
            .when(host.contains("perplexity"), "Perplexity")
            .when(host.contains("deepseek"), "DeepSeek")
            .otherwise("Custom AI"))


def vendor_of(model: Column) -> Column:
    """Vendor of a model name; anything unknown counts as chatgpt."""
    name = F.lower(F.coalesce(model, F.lit("")))
    return (F.when(name.contains("claude") | name.contains("anthropic"), "claude")
            .when(name.contains("gemini") | name.contains("google"), "gemini")
            .when(name.contains("deepseek"), "deepseek")
            .when(name.contains("perplexity") | name.contains("sonar"), "perplexity")
            .otherwise("chatgpt"))
