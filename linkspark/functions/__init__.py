"""Column functions: text, names, addresses, countries, transliteration."""
