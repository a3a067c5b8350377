"""momentlake.streaming"""
