from sojourn.functions import dates, text

__all__ = ["dates", "text"]
