"""The engine's operators: detectors, learning, matching, surrogates, audits."""
