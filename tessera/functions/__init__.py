"""Functions on columns and small frames: answers, tagged texts, masks, rollout rewards."""
