"""Operations of a training-data pipeline; nothing else in lectern imports this package."""
