"""momentlake.plans"""
