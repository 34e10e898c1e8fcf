"""Made-up texts."""

WORDS = "the of and to in that is was for with as on be at by this have from or one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
