"""DataFrame operators: levels, sound quality, detectability, responses, statistics."""
