"""Generation over streams."""
